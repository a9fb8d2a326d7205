import struct
import zlib

import numpy as np
import pytest

from weftline.functions import images as im


def filtered(img, kinds):
    """A PNG file whose rows use the given filters."""
    h, w, c = img.shape
    rows, above = [], np.zeros(w * c, int)
    for y in range(h):
        line = img[y].reshape(-1).astype(int)
        left = np.r_[np.zeros(c, int), line[:-c]]
        corner = np.r_[np.zeros(c, int), above[:-c]]
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.choose(d.argmin(0), [left, above, corner])
        guess = [0 * line, left, above, (left + above) // 2, paeth][kinds[y % len(kinds)]]
        rows.append(bytes([kinds[y % len(kinds)]]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"0000"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_round_trip():
    rnd = np.random.default_rng(0)
    for shape in ((7, 5), (4, 9, 3), (1, 1)):
        img = rnd.integers(0, 256, shape, dtype=np.uint8)
        assert (im.png_array(im.png_bytes(img)) == img).all()
    with pytest.raises(ValueError):
        im.png_array(b"no")


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png_filters(kinds):
    img = np.random.default_rng(1).integers(0, 256, (9, 6, 3), dtype=np.uint8)
    assert (im.png_array(filtered(img, kinds)) == img).all() and (im.decode(filtered(img, kinds)) == img).all()


def test_resampling():
    flat = np.full((20, 30, 3), 77, np.uint8)
    for kernel in im.KERNELS:
        assert (im.resample(flat, 7, 50, kernel) == 77).all()
        img = np.random.default_rng(2).integers(0, 256, (16, 16), dtype=np.uint8)
        assert (im.resample(img, 16, 16, kernel) == img).all()
        ramp = np.tile(np.arange(0, 200, 2, dtype=np.uint8), (4, 1))
        assert np.abs(im.resample(ramp, 4, 50, kernel)[:, 5:-5].astype(int) - (np.arange(50) * 4 + 1)[5:-5]).max() <= 1


def test_canvas_and_thumbnail():
    c = im.canonical(np.zeros((10, 5, 3), np.uint8), 8, 8)
    assert c.shape == (8, 8, 3) and (c[:, :2] == 255).all() and (c[:, 2:6] == 0).all()
    kind, body = im.thumbnail(im.png_bytes(np.zeros((100, 1000, 3), np.uint8)))
    assert kind in ("image/png", "image/jpeg") and (kind == "image/jpeg" or im.png_array(body).shape == (42, 420, 3))
    assert im.thumbnail(b"junk") is None is im.thumbnail(None)

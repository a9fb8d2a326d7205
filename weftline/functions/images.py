"""Image files and resampling in numpy: PNG both ways, windowed resampling, thumbnails. No image library is needed."""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_DEPTHS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # PNG colour type -> samples of a pixel


def png_bytes(img: np.ndarray) -> bytes:
    """A PNG file of an H x W or H x W x 3 array of bytes."""
    img = np.ascontiguousarray(img, np.uint8)
    h, w = img.shape[:2]
    rows = np.zeros((h, 1 + img[0].size if h else 1), np.uint8)  # each row is led by its filter, 0: none
    rows[:, 1:] = img.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def _chunks(content: bytes):
    at = len(_SIGNATURE)
    while at + 8 <= len(content):
        (n,) = struct.unpack_from(">I", content, at)
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples without their PNG filters; ``step`` bytes lie between a sample and its left neighbour."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(raw):
        kind, line = int(row[0]), row[1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for s in range(step):
                out[y, s::step] = np.cumsum(line[s::step], dtype=np.uint64)
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            cur, up, diff = out[y].astype(int).tolist(), above.tolist(), line.tolist()
            for x, v in enumerate(diff):
                a, b, c = (cur[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                cur[x] = (v + guess) & 255
            out[y] = cur
        else:
            raise ValueError("unknown filter")
        above = out[y]
    return out


def png_array(content: bytes) -> np.ndarray:
    """H x W (grey) or H x W x 3 bytes of a PNG file that isn't interlaced; transparency is left out. Other files are an error."""
    if content[:8] != _SIGNATURE:
        raise ValueError("no PNG file")
    data, palette, head = [], None, None
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    w, h, bits, colour, _, _, interlace = head
    if interlace or colour not in _DEPTHS or bits == 16:
        raise ValueError("a kind of PNG that isn't read")
    samples = _DEPTHS[colour]
    size = 1 + (w * samples * bits + 7) // 8
    rows = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)[: h * size].reshape(h, size), max(1, samples * bits // 8))
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(h, -1, bits)[:, :w]
        rows = each @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
        if colour == 0:
            rows = rows * (255 // ((1 << bits) - 1))
    px = rows.reshape(h, w, samples) if samples > 1 else rows.reshape(h, w)
    if colour == 3:
        return palette[px]
    return np.ascontiguousarray(px[..., 0] if colour == 4 else px[..., :3] if colour == 6 else px)


def decode(content: bytes | None) -> np.ndarray | None:
    """H x W x 3 bytes of an image (binary PGM and PPM, PNG, and what Pillow reads where it is installed), None if it can't be read."""
    if not content:
        return None
    try:
        m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", content)
        if m:
            w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
            px = np.frombuffer(content, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
        elif content[:8] == _SIGNATURE:
            px = png_array(content)
            px = px[..., None] if px.ndim == 2 else px
        else:
            from PIL import Image

            px = np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
        return np.repeat(px, 3, 2) if px.shape[2] == 1 else px.copy()
    except Exception:  # noqa: BLE001 - whatever a codec raises, the frame is unreadable
        return None


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


#: Kernel -> (function, reach).
KERNELS = {"lanczos": (_lanczos, 3.0), "bicubic": (_cubic, 2.0)}


def _weights(n: int, to: int, kernel: str) -> np.ndarray:
    """Weight of each source pixel for each target pixel along one axis; the kernel is widened when the axis shrinks."""
    shape, reach = KERNELS[kernel]
    scale = max(n / to, 1.0)
    centre = (np.arange(to) + 0.5) * n / to
    d = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(d) < reach, shape(d), 0.0)
    return w / w.sum(1, keepdims=True)


def resample(img: np.ndarray, height: int, width: int, kernel: str = "lanczos") -> np.ndarray:
    """An H x W or H x W x C array of bytes at another size, by a separable kernel (``lanczos`` or ``bicubic``), rounded to bytes after each axis."""
    byte = lambda x: np.clip(np.rint(x), 0, 255)
    flat = img.reshape(*img.shape[:2], -1).astype(np.float64)
    out = byte(np.einsum("xw,hwc->hxc", _weights(img.shape[1], width, kernel), flat)) if width != img.shape[1] else flat
    out = byte(np.einsum("yh,hxc->yxc", _weights(img.shape[0], height, kernel), out)) if height != img.shape[0] else out
    return out.astype(np.uint8).reshape(height, width, *img.shape[2:])


def canonical(img: np.ndarray, width: int = 768, height: int = 1024, fill: int = 255) -> np.ndarray:
    """A frame fitted into a canvas of one colour with its proportions kept."""
    h, w = img.shape[:2]
    s = min(width / w, height / h)
    nh, nw = max(1, round(h * s)), max(1, round(w * s))
    out = np.full((height, width, *img.shape[2:]), fill, np.uint8)
    top, left = (height - nh) // 2, (width - nw) // 2
    out[top : top + nh, left : left + nw] = resample(img, nh, nw)
    return out


def thumbnail(content: bytes | None, side: int = 420, quality: int = 78) -> tuple[str, bytes] | None:
    """(media type, bytes) of a picture at most ``side`` pixels wide and high: JPEG where Pillow is installed, else PNG. None if it can't be read."""
    img = decode(content)
    if img is None:
        return None
    h, w = img.shape[:2]
    s = min(1.0, side / max(h, w))
    small = resample(img, max(1, round(h * s)), max(1, round(w * s)), "bicubic")
    try:
        from PIL import Image
    except ImportError:
        return "image/png", png_bytes(small)
    out = io.BytesIO()
    Image.fromarray(small).save(out, "JPEG", quality=quality)
    return "image/jpeg", out.getvalue()


def line_chart(lines: list[tuple[np.ndarray, np.ndarray, tuple[int, int, int]]], width: int = 900, height: int = 400, margin: int = 20) -> np.ndarray:
    """Lines (x, y, colour) in one frame over common axes; unknown values break a line."""
    out = np.full((height, width, 3), 255, np.uint8)
    out[[margin, height - margin - 1], margin : width - margin] = 200
    out[margin : height - margin, [margin, width - margin - 1]] = 200
    x, y = (np.concatenate([np.asarray(line[i], float) for line in lines]) if lines else np.zeros(0) for i in (0, 1))
    known = np.isfinite(x) & np.isfinite(y)
    if not known.any():
        return out
    low, span = np.array([x[known].min(), y[known].min()]), np.array([np.ptp(x[known]), np.ptp(y[known])])
    span[span == 0] = 1
    for xs, ys, colour in lines:
        px = margin + (np.asarray(xs, float) - low[0]) / span[0] * (width - 2 * margin - 1)
        py = height - 1 - margin - (np.asarray(ys, float) - low[1]) / span[1] * (height - 2 * margin - 1)
        for a, b in zip(np.stack([px, py], 1)[:-1], np.stack([px, py], 1)[1:]):
            if np.isfinite(a).all() and np.isfinite(b).all():
                steps = np.linspace(0, 1, int(np.abs(b - a).max()) + 2)[:, None]
                at = np.rint(a + (b - a) * steps).astype(int)
                out[at[:, 1], at[:, 0]] = colour
    return out

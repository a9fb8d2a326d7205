import numpy as np
import pytest

from weftline.functions import tensors as t


def test_layout():
    person, garment = np.ones((2, 4, 8, 6), np.float32), np.full((2, 4, 8, 6), 2, np.float32)
    mask = np.zeros((2, 1, 64, 48), np.float32)
    mask[:, :, :32] = 1
    target, m, context = t.side_by_side(person, garment, mask)
    assert target.shape == context.shape == (2, 4, 8, 12) and m.shape == (2, 1, 8, 12)
    assert (m[..., :4, :6] == 1).all() and not m[..., 6:].any() and not m[..., 4:, :].any()
    assert (context[..., :4, :6] == 0).all() and (context[..., 4:, :6] == 1).all() and (context[..., 6:] == 2).all()
    assert t.model_channels(target, m, context).shape == (2, 9, 8, 12) and (t.person_side(target) == person).all()
    assert t.no_conditioning(3).shape == (3, 77, 768)


def test_error_and_bytes():
    e, m = np.zeros((1, 4, 2, 2)), np.zeros((1, 1, 2, 4))
    e[..., 0, 0], m[..., 0, 0] = 3, 1
    assert t.error_inside(e, m) == 3 and t.error_inside(e, m * 0) == 0
    assert t.to_bytes(np.array([-2, -1, 0, 1, 2])).tolist() == [0, 0, 127, 255, 255]
    assert (t.pair_noise([5, 6], (2,)) == t.pair_noise([5, 6], (2,))).all() and not (t.pair_noise([5], (2,)) == t.pair_noise([6], (2,))).all()


class Parameter:
    def __init__(self, n):
        self.n, self.requires_grad = n, True

    def numel(self):
        return self.n


class Model:
    def __init__(self, parts):
        self.parts = parts

    def parameters(self):
        return [p for v in self.parts.values() for p in v]

    def named_modules(self):
        return [(k, Model({"": v})) for k, v in self.parts.items()]


def test_freezing():
    m = Model({"a.attn1": [Parameter(3)], "a.attn2": [Parameter(5)]})
    assert t.size_of(t.train_only(m)) == 3 and [p.requires_grad for p in m.parameters()] == [True, False]
    with pytest.raises(RuntimeError):
        t.train_only(m, "none")

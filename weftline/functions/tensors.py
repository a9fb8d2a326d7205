"""Array layout of a try-on training batch in numpy: what a worker does between Spark's rows and its model.

Arrays are batch x channels x height x width. The model itself is the worker's; see ``train_on_workers``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from weftline.functions.pixels import resize_nearest


def side_by_side(person: np.ndarray, garment: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, mask, context), twice as wide as a latent: the person on the left, the garment on the right.

    The mask is brought to latent size by the nearest pixel; the garment's half is never repainted, and the context hides what is.
    """
    h, w = person.shape[-2:]
    small = np.stack([np.stack([resize_nearest(c, h, w) for c in m]) for m in mask]).astype(person.dtype)
    join = lambda a, b: np.concatenate((a, b), axis=3)
    return join(person, garment), join(small, np.zeros_like(small)), join(np.where(small > 0, 0, person).astype(person.dtype), garment)


def model_channels(noisy: np.ndarray, mask: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Noise, mask and context as one array of channels."""
    return np.concatenate((noisy, mask, context), axis=1)


def person_side(latents: np.ndarray) -> np.ndarray:
    return np.split(latents, 2, axis=3)[0]


def no_conditioning(batch: int, tokens: int = 77, width: int = 768, dtype=np.float32) -> np.ndarray:
    return np.zeros((batch, tokens, width), dtype)


def error_inside(error: np.ndarray, mask: np.ndarray) -> float:
    """Mean squared error over the masked part of the person's half; 0 for an empty mask."""
    inside = np.broadcast_to(mask[..., : error.shape[-1]] > 0, error.shape)
    return float(error[inside].mean()) if inside.any() else 0.0


def to_bytes(images: np.ndarray) -> np.ndarray:
    """-1..1 to 0..255."""
    return np.clip((images + 1) * 127.5, 0, 255).astype(np.uint8)


def pair_noise(seeds: Iterable[int], shape: tuple[int, ...]) -> np.ndarray:
    """Starting noise that depends on a pair's seed only, so runs are compared from equal starts."""
    return np.stack([np.random.default_rng(s % 2**63).standard_normal(shape) for s in seeds]).astype(np.float32)


def train_only(model, ending: str = "attn1") -> list:
    """Freeze a model but for the modules whose name has this ending; returns their parameters. No such module is an error."""
    for p in model.parameters():
        p.requires_grad = False
    kept = [p for name, part in model.named_modules() if name.endswith(ending) for p in part.parameters()]
    if not kept:
        raise RuntimeError(f"no module is called {ending!r}")
    for p in kept:
        p.requires_grad = True
    return kept


def size_of(parameters: Iterable) -> int:
    return sum(p.numel() for p in parameters)


def train_on_workers(function: Callable, *args, processes: int = 1, use_gpu: bool = True):
    """Run a training function on executors with Spark's distributor; needs torch, which this library doesn't."""
    try:
        from pyspark.ml.torch.distributor import TorchDistributor
    except ImportError as e:
        raise RuntimeError("training needs torch on driver and executors") from e
    return TorchDistributor(num_processes=processes, local_mode=False, use_gpu=use_gpu).run(function, *args)

"""Scorers of patches: a deterministic one, and the attention U-Net's layers in numpy for given weights.

Weights are not part of this library. A scorer is a function without arguments that loads what it needs
and returns a function from patches (n, height, width) to logits of the same shape; it is sent to the
tasks of ``raster.predicted``.
"""

from __future__ import annotations

import collections
import io
import pickle
import zipfile
from collections.abc import Callable

import numpy as np

from .raster import centre_weights

Weights = dict[str, np.ndarray]
#: Bottlenecks of each encoder stage, and channels of the stages: fixed values of the architecture.
BOTTLENECKS = (3, 8, 36, 3)
STAGE_CHANNELS = (256, 512, 1024, 2048)


def contrast_scorer(gain: float = 10.0, level: float = 0.1) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A scorer without weights: the logit is gain * (value - level)."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: gain * (x - level)

    return load


#: Number types of stored tensors by the name of their storage: fixed values.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "?"}


class _Names(pickle.Unpickler):
    """Reads only what a table of named tensors is made of; any other class is an error."""

    def __init__(self, archive: zipfile.ZipFile, root: str):
        super().__init__(io.BytesIO(archive.read(f"{root}/data.pkl")))
        self.archive, self.root = archive, root

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if (module, name) in (("torch._utils", "_rebuild_tensor_v2"), ("torch._utils", "_rebuild_parameter")):
            return getattr(self, name)
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        raise pickle.UnpicklingError(f"{module}.{name} isn't part of a table of tensors")

    def persistent_load(self, pid: tuple) -> np.ndarray:
        return np.frombuffer(self.archive.read(f"{self.root}/data/{pid[2]}"), dtype=pid[1])

    @staticmethod
    def _rebuild_tensor_v2(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
        steps = tuple(n * storage.itemsize for n in stride)
        return np.lib.stride_tricks.as_strided(storage[offset:], size, steps).copy()

    @staticmethod
    def _rebuild_parameter(data: np.ndarray, *_) -> np.ndarray:
        return data


def state_of(path: str) -> dict[str, np.ndarray]:
    """The named arrays of an .npz file, or of a zipped table of tensors (.pth); a prefix ``module.`` of all names goes."""
    with zipfile.ZipFile(path) as archive:
        pickled = next((n for n in archive.namelist() if n.endswith("data.pkl")), None)
        if pickled is not None:
            found = _Names(archive, pickled.rpartition("/")[0]).load()
            found = found.get("state_dict", found)
            return {k.removeprefix("module."): v for k, v in found.items() if isinstance(v, np.ndarray)}
    with np.load(path) as f:
        return dict(f)


def weights_scorer(path: str, bottlenecks: tuple[int, ...] = BOTTLENECKS) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The attention U-Net with weights from an .npz or .pth file at this path on every executor; a missing name or file is an error."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        weights = state_of(path)
        return lambda x: unet(x[:, None], weights, bottlenecks)[:, 0]

    return load


def on_canvas(scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A scorer that sees patches resampled to size x size cells (bilinear) and gives logits back at their own size (nearest)."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        score = scorer()

        def run(x: np.ndarray) -> np.ndarray:
            height, width = x.shape[1:]
            rows, cols = centre_weights(height, size), centre_weights(width, size)
            up = np.einsum("ij,njk,lk->nil", rows, x, cols, optimize=True)
            back = score(up)
            r, c = ((np.arange(n) + 0.5) * size / n for n in (height, width))
            return back[:, r.astype(int)[:, None], c.astype(int)[None, :]]

        return run

    return load


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray | None = None, stride: int = 1, pad: int = 0) -> np.ndarray:
    """2-D convolution of (n, channels, height, width)."""
    x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
    windows = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3))[:, :, ::stride, ::stride]
    out = np.einsum("nchwij,ocij->nohw", windows, w, optimize=True)
    return out if b is None else out + b[None, :, None, None]


def batch_norm(x: np.ndarray, weights: Weights, name: str, eps: float = 1e-5) -> np.ndarray:
    """By the running statistics."""
    mean, var, gain, shift = (weights[f"{name}.{k}"][None, :, None, None] for k in ("running_mean", "running_var", "weight", "bias"))
    return (x - mean) / np.sqrt(var + eps) * gain + shift


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def max_pool(x: np.ndarray, size: int = 3, stride: int = 2, pad: int = 1) -> np.ndarray:
    x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(x, (size, size), axis=(2, 3))[:, :, ::stride, ::stride].max(axis=(4, 5))


def resize_nearest(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The cell at floor(i * old / new)."""
    rows, cols = np.arange(height) * x.shape[2] // height, np.arange(width) * x.shape[3] // width
    return x[:, :, rows[:, None], cols[None, :]]


def channel_attention(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    """Channels weighed by the logistic of a shared two-layer map of their mean and of their maximum."""
    down, up = weights[f"{name}.fc1.weight"], weights[f"{name}.fc2.weight"]
    shared = lambda pooled: conv(relu(conv(pooled, down)), up)
    return x * logistic(shared(x.mean(axis=(2, 3), keepdims=True)) + shared(x.max(axis=(2, 3), keepdims=True)))


def spatial_attention(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    """Places weighed by the logistic of a 7 x 7 convolution of the channels' mean and maximum."""
    pooled = np.concatenate([x.mean(axis=1, keepdims=True), x.max(axis=1, keepdims=True)], axis=1)
    return x * logistic(conv(pooled, weights[f"{name}.conv1.weight"], pad=3))


def attention(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    return spatial_attention(channel_attention(x, weights, f"{name}.channel_attention"), weights, f"{name}.spatial_attention")


def bottleneck(x: np.ndarray, weights: Weights, name: str, stride: int) -> np.ndarray:
    """1 x 1, 3 x 3 (with the stride), 1 x 1 convolutions beside a shortcut."""
    y = relu(batch_norm(conv(x, weights[f"{name}.conv1.weight"]), weights, f"{name}.bn1"))
    y = relu(batch_norm(conv(y, weights[f"{name}.conv2.weight"], stride=stride, pad=1), weights, f"{name}.bn2"))
    y = batch_norm(conv(y, weights[f"{name}.conv3.weight"]), weights, f"{name}.bn3")
    if f"{name}.downsample.0.weight" in weights:
        x = batch_norm(conv(x, weights[f"{name}.downsample.0.weight"], stride=stride), weights, f"{name}.downsample.1")
    return relu(x + y)


def unet(x: np.ndarray, weights: Weights, bottlenecks: tuple[int, ...] = BOTTLENECKS) -> np.ndarray:
    """Logits of (n, 1, height, width): residual encoder, attention on each level, decoder by nearest upsampling."""
    levels = [max_pool(relu(batch_norm(conv(x, weights["encoder.0.weight"], stride=2, pad=3), weights, "encoder.1")))]
    for stage, n in enumerate(bottlenecks):
        y = levels[-1]
        for k in range(n):
            y = bottleneck(y, weights, f"encoder.{4 + stage}.{k}", 2 if stage and not k else 1)
        levels.append(y)
    levels = [attention(y, weights, name) for y, name in zip(levels, ("cbam1", "cbam2", "cbam3", "cbam4", "cbam_center"), strict=True)]
    y = levels.pop()
    for depth in (4, 3, 2, 1):
        skip = levels.pop()
        y = np.concatenate([resize_nearest(y, *skip.shape[2:]), skip], axis=1)
        for layer in (0, 2):
            y = relu(conv(y, weights[f"decoder{depth}.{layer}.weight"], weights[f"decoder{depth}.{layer}.bias"], pad=1))
    return resize_nearest(conv(y, weights["output.weight"], weights["output.bias"]), *x.shape[2:])

"""Scoring of tiles: resampling to the model grid, a pluggable segmenter, cropping and binarising."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Config
from ..shipping import shipped

READ_STRATEGIES = ("graph", "graph_aa", "overview", "consumer", "onnx_gpu", "cupy")


class Segmenter(Protocol):
    """Scores of a batch: NHWC in, NHW1 out. Pixels come in its dtype, if it has one, else as float32."""

    def predict_on_batch(self, x: np.ndarray) -> np.ndarray: ...


class PixelSegmenter:
    """A logistic model of single pixels: the smallest segmenter there is, for tests.

    Scores are doubles, by way of tanh: one is 0.5 only where the sum is 0.
    """

    dtype = np.float64

    def __init__(self, weights: list[float], bias: float = 0.0):
        self.weights, self.bias = np.asarray(weights, self.dtype), self.dtype(bias)

    def predict_on_batch(self, x: np.ndarray) -> np.ndarray:
        return (0.5 + 0.5 * np.tanh((x @ self.weights + self.bias) / 2))[..., None]


class OnnxSegmenter:
    """A model file, in either channel order; the session is made once for each worker."""

    _sessions: dict[str, object] = {}

    def __init__(self, path: str):
        if not path.lower().endswith(".onnx"):
            raise RuntimeError(f"not an ONNX model: {path}")
        self.path = path

    def predict_on_batch(self, x: np.ndarray) -> np.ndarray:
        import onnxruntime

        if self.path not in self._sessions:
            self._sessions[self.path] = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        session = self._sessions[self.path]
        first = session.get_inputs()[0]
        channels_first = len(first.shape) == 4 and first.shape[1] in (1, 3)
        y = session.run(None, {first.name: np.moveaxis(x, -1, 1) if channels_first else x})[0]
        return (np.moveaxis(y, 1, -1) if channels_first else y).astype(np.float32)


def strategy(name: str | None) -> str:
    """A read strategy by name; unknown names and one that needs a GPU library raise."""
    s = (name or "graph").lower()
    if s not in READ_STRATEGIES:
        raise ValueError(f"unknown read strategy {name!r}")
    if s == "cupy":
        raise RuntimeError("the read strategy cupy needs a GPU library")
    return "graph" if s == "onnx_gpu" else s


def cubic_matrix(n: int, m: int, antialias: bool = False) -> np.ndarray:
    """Weights (m, n) of Keys' cubic kernel (a = -0.5) at half-pixel centres.

    Taps outside the input are left out and the rest is scaled to a sum of 1. With
    antialias the kernel is as wide as the step when shrinking.
    """
    scale = n / m
    width = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(m) + 0.5) * scale - 0.5
    x = np.abs((np.arange(n)[None, :] - centre[:, None]) / width)
    w = np.where(x <= 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    return (w / w.sum(1, keepdims=True)).astype(np.float64)


@lru_cache(maxsize=16)
def taps(n: int, m: int, antialias: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places (m, k) of the input that an output takes, ascending, and their weights; 0 where there are fewer."""
    w = cubic_matrix(n, m, antialias)
    at = np.argsort(w == 0, axis=1, kind="stable")[:, : (w != 0).sum(1).max()]
    return at, np.take_along_axis(w, at, 1)


def resize(batch: np.ndarray, size: int, cubic: bool = True, antialias: bool = False, full: float = 1.0) -> np.ndarray:
    """NHWC to NHWC of size x size, as parts of full; masks (cubic=False) take the nearest pixel; same size: as is.

    Doubles are summed term by term, by the input's rows and then columns: a sum that lies on a
    threshold comes out as in a query that adds the same terms in this order.
    """
    _, h, w, _ = batch.shape
    if h == w == size:
        return batch if full == 1 else batch / full
    if not cubic:
        pick = lambda k: np.minimum(((np.arange(size) + 0.5) * k / size).astype(int), k - 1)
        return batch[:, pick(h)][:, :, pick(w)]
    (rows, down), (columns, across) = taps(h, size, antialias), taps(w, size, antialias)
    out = np.zeros((len(batch), size, size, batch.shape[3]))
    for r, u in zip(rows.T, down.T, strict=True):
        lines = batch[:, r].astype(np.float64)
        for c, v in zip(columns.T, across.T, strict=True):
            term = lines[:, :, c]
            term *= np.multiply.outer(u, v)[None, :, :, None]
            if full != 1:
                term /= full
            out += term
    return out


def adaptive(score, batch: np.ndarray) -> np.ndarray:
    """Scores a batch; on lack of memory in halves, in order, down to single tiles."""
    try:
        return score(batch)
    except (MemoryError, RuntimeError) as e:
        low = str(e).lower()
        if len(batch) == 1 or not (isinstance(e, MemoryError) or "memory" in low or "alloc" in low):
            raise
        half = len(batch) // 2
        return np.concatenate([adaptive(score, batch[:half]), adaptive(score, batch[half:])])


def segment(pixels: np.ndarray, valid: np.ndarray, segmenter: Segmenter, c: Config = Config(), antialias: bool = False) -> np.ndarray:
    """uint8 NHWC and its validity to binary cores: resize, score, crop, threshold."""
    x = pixels[..., :3]
    if x.shape[-1] < 3:
        x = np.concatenate([x, np.zeros((*x.shape[:3], 3 - x.shape[-1]), x.dtype)], -1)
    x = resize(x, c.img_width, True, antialias, 255.0).astype(getattr(segmenter, "dtype", np.float32), copy=False)
    v = resize(valid[..., None].astype(np.uint8), c.img_width, False)[..., 0] > 0
    y = adaptive(segmenter.predict_on_batch, x)[..., 0]
    k = c.overlap_pred // 2
    core = slice(k, c.img_width - k)
    return ((y >= c.prediction_threshold) & v)[:, core, core].astype(np.uint8)


def segment_tiles(tiles: DataFrame, segmenter: Segmenter, c: Config = Config(), batch: int = 4) -> DataFrame:
    """tiles (tile_id, height, width, bands, pixels binary) to set pixels (tile_id, r, c) of the cores.

    One Python call does all of it, so that no score leaves a worker.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, same in f.groupby(["height", "width", "bands"]):
                for at in range(0, len(same), batch):
                    part = same.iloc[at : at + batch]
                    h, w, b = (int(part[k].iloc[0]) for k in ("height", "width", "bands"))
                    x = np.stack([np.frombuffer(p, np.uint8).reshape(h, w, b) for p in part["pixels"]])
                    y = segment(x, (x != 0).any(-1), segmenter, c)
                    n, r, col = np.nonzero(y)
                    yield pd.DataFrame({"tile_id": part["tile_id"].to_numpy()[n], "r": r, "c": col})

    return shipped(tiles).select("tile_id", "height", "width", "bands", "pixels").mapInPandas(run, "tile_id long, r long, c long")

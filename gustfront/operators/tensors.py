"""Array form of the model-input transform: rasters at rest, one row per scan, no shuffle.

The long-form operators in ``grids`` define the same result; here crop and resize run as two
small matrix products per raster inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.constants import BOX_KM, REFLECTIVITY_CODES, TENSOR_SIDE, VELOCITY_CODES
from gustfront.operators.grids import crop_boxes
from gustfront.session import deal_out


def weight_matrix(n: int, out: int) -> np.ndarray:
    """``out`` x ``n`` triangle-filter weights; rows sum to one."""
    scale = n / out
    support = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    gap = np.abs((np.arange(n) + 0.5)[None, :] - centre[:, None]) / support
    weights = np.clip(1.0 - gap, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def normalise(raster: np.ndarray, codes: dict) -> np.ndarray:
    shares = np.clip(raster.astype(np.float32) / np.float32(codes["denom"]), 0.0, 1.0)
    return np.where(np.isin(raster, codes["missing"]), np.float32(0.0), shares)


def crop(raster: np.ndarray, r0: int, c0: int, side: int) -> np.ndarray:
    """Square window with zero padding outside the raster."""
    box = np.zeros((side, side), dtype=np.float32)
    top, left = max(0, r0), max(0, c0)
    bottom, right = min(raster.shape[0], r0 + side), min(raster.shape[1], c0 + side)
    if bottom > top and right > left:
        box[top - r0 : bottom - r0, left - c0 : right - c0] = raster[top:bottom, left:right]
    return box


def build_tensors(frames: DataFrame, box_km: float = BOX_KM, out: int = TENSOR_SIDE) -> DataFrame:
    """Two-channel model input per scan.

    ``frames(scan_id, height, width, refl, vel, a, e, c, f, lat, lon)`` hold palette indices as
    row-major arrays; ``vel`` may be NULL, which gives a zero channel. Adds ``tensor`` (2*out*out
    floats), ``in_bounds`` and ``has_velocity``.
    """
    kind = dict(frames.dtypes)["scan_id"]
    boxed = crop_boxes(deal_out(frames), F.col("height"), F.col("width"), box_km, keep=["height", "width", "refl", "vel"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                side = int(row.npix)
                if side not in known:
                    known[side] = weight_matrix(side, out)
                weights = known[side]
                planes = []
                for values, codes in ((row.refl, REFLECTIVITY_CODES), (row.vel, VELOCITY_CODES)):
                    if values is None:
                        planes.append(np.zeros(out * out, dtype=np.float32))
                        continue
                    raster = np.asarray(values).reshape(int(row.height), int(row.width))
                    box = crop(normalise(raster, codes), int(row.r0), int(row.c0), int(row.npix))
                    wide = (box @ weights.T).astype(np.float32)
                    planes.append((weights @ wide).astype(np.float32).ravel())
                rows.append((row.scan_id, np.concatenate(planes), float(row.in_bounds), row.vel is not None))
            yield pd.DataFrame(rows, columns=["scan_id", "tensor", "in_bounds", "has_velocity"])

    return boxed.mapInPandas(run, f"scan_id {kind}, tensor array<float>, in_bounds double, has_velocity boolean")

"""User functions over column batches and over logical batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelquilt.operators.batching import BATCH


def map_batches(df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, batch_size: int, **bound) -> DataFrame:
    """Apply ``fn`` to column batches of ``batch_size`` rows (the last of a partition may be shorter)."""

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows < batch_size:
                continue
            joined = pd.concat(held, ignore_index=True)
            whole = rows - rows % batch_size
            for start in range(0, whole, batch_size):
                yield fn(joined.iloc[start : start + batch_size].reset_index(drop=True), **bound)
            held = [joined.iloc[whole:]]
            rows -= whole
        if rows:
            yield fn(pd.concat(held, ignore_index=True), **bound)

    return df.mapInPandas(chunks, schema)


def _edges(frame: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where logical batches begin in rows that lie batch by batch, and where the last one ends. Null keys are equal."""
    own, last = frame[keys].iloc[1:].reset_index(drop=True), frame[keys].iloc[:-1].reset_index(drop=True)
    new = ((own != last) & ~(own.isna() & last.isna())).any(axis=1)
    return [0, *(np.flatnonzero(new.to_numpy()) + 1).tolist(), len(frame)]


def collate_batches(
    df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, keys: list[str] = BATCH, order: str = "pos", **bound
) -> DataFrame:
    """Apply ``fn`` to each logical batch, its rows in order. A batch has a fixed number of rows.

    Rows are arranged by batch once and then stream through the workers; every block of rows that arrives is cut into the
    logical batches it holds, and the one at its end waits for the next block. So what crosses to Python and back are
    blocks of many batches, and no batch has a round trip of its own.
    """
    make = partial(fn, **bound)

    def collate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            edges = _edges(frame, keys)
            done = [make(frame.iloc[a:b].reset_index(drop=True)) for a, b in zip(edges[:-2], edges[1:-1])]
            held = frame.iloc[edges[-2] :]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield make(held.reset_index(drop=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(collate, schema)

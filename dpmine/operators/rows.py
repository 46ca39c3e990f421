"""Combining one-row results without joins, and cutting Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dpmine.session import release_memory


def side_by_side(frames: list[DataFrame], key: str | None = None) -> DataFrame:
    """Frames of one row (per ``key``) with disjoint columns → one row with all columns.

    A union with null padding and one aggregation: no join, so no constant
    join condition for the optimiser to turn into a nested-loop join.
    """
    cols: list[tuple[str, object]] = []
    for f in frames:
        for fld in f.schema.fields:
            if fld.name != key and fld.name not in [c for c, _ in cols]:
                cols.append((fld.name, fld.dataType))
    padded = []
    for f in frames:
        have = set(f.columns)
        sel = ([F.col(key)] if key else []) + [F.col(c) if c in have else F.lit(None).cast(t).alias(c)
                                                 for c, t in cols]
        padded.append(f.select(*sel))
    u = padded[0]
    for p in padded[1:]:
        u = u.unionByName(p)
    aggs = [F.first(c, ignorenulls=True).alias(c) for c, _ in cols]
    return u.groupBy(key).agg(*aggs) if key else u.agg(*aggs)


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``max_bytes`` (a row is never cut); bounds a worker's memory.

    When the task ends, freed memory goes back to the system: workers live on between stages.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, int(rows * max_bytes / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    release_memory()

"""Posting lists of an inverted index, dealt to tasks and compared pair by pair there.

A list is cut into chunks by hash, and every pair of its chunks is a task of its own, so no list is one task's. A task
turns what it links into stars around the smallest name that they reach, so what it returns grows with the rows that
it reads, not with the pairs that it compares.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, materialize, partitions
from strata.llm.repeats import group_starts

#: Rows that a task gathers before it compares, and pairs compared at once.
ROWS, STEP = 1 << 16, 1 << 19
#: Long groups whose numbers of chunks are sent to all executors (24 bytes each); more of them are joined.
MOST_SENT = 1 << 16
#: ``at`` holds a pair of chunks and the row's own chunk in this many bits each.
_BITS = 21
_LOW = (1 << _BITS) - 1


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as links of every node to the smallest one that it reaches; that one itself is left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new, m = low.copy(), np.minimum(low[i], low[j])
        for x in (i, j, low[i], low[j]):
            np.minimum.at(new, x, m)
        while (further := new[new]).tobytes() != new.tobytes():
            new = further
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def equal_bytes(difference: np.ndarray) -> np.ndarray:
    """Positional bytes that two words share, of their exclusive or."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count(((difference & low) + low | difference) & ~low)


def dealt(rows: DataFrame, by: str, key: str, count: int, chunk: int, weight: Column | None = None, heaviest: int = 1) -> DataFrame:
    """rows with ``at``: the pair of chunks of its group (``by``) that a row meets in, and which of them it is in.

    A group has one chunk for every ``chunk`` rows or ``heaviest`` of the weight. To find the few long groups, rows
    are counted by a hash first, whose values number as many as count / chunk, and only groups in full ones by name.
    """
    load = F.ceil(F.count(F.lit(1)) / chunk)
    load = (F.greatest(load, F.ceil(F.sum(weight) / heaviest)) if weight is not None else load).cast("long").alias("c")
    bucket = F.pmod(F.xxhash64(by), F.lit(max(1 << 16, 4 * count // chunk))).alias("bucket")
    full = materialize(rows.groupBy(bucket).agg(load).where("c > 1").select("bucket"))
    if full.isEmpty():
        discard(full)
        return rows.withColumn("at", F.lit(0).cast("long"))
    long = materialize(rows.withColumn("bucket", bucket).join(full, "bucket", "left_semi").groupBy(by).agg(load).where("c > 1"))
    discard(full)
    found = long.agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).first()
    if (found["c"] or 0) > _LOW:
        raise ValueError(f"a group of {found['c']} chunks is longer than can be numbered")
    met = rows.join(F.broadcast(long) if found["n"] <= MOST_SENT else long, by, "left").withColumn("c", F.coalesce("c", F.lit(1).cast("long")))
    met = met.withColumn("own", F.pmod(F.xxhash64(key), F.col("c"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    at = F.least("own", "other") * (1 << 2 * _BITS) + F.greatest("own", "other") * (1 << _BITS) + F.col("own")
    return met.withColumn("at", at).drop("c", "own", "other")


def gathered(rows: DataFrame, by: str) -> DataFrame:
    """Rows of a group's pair of chunks in one task, one after another."""
    return rows.withColumn("pair", F.shiftright("at", _BITS)).repartition(partitions(rows.sparkSession), by, "pair").sortWithinPartitions(by, "at").drop("pair")


def blocks(batches, by: str, rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole groups of gathered rows, many at once, with where each begins (and the last ends) and ``at``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n < rows:
                continue
        if not n:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.column("at").to_numpy()
        cut = group_starts(table.column(by).to_numpy(), at >> _BITS)
        cut = cut if b is None else cut[:-1]
        stop = int(cut[-1])
        if stop:
            yield table.slice(0, stop), cut, at[:stop]
        held, n = table.slice(stop).to_batches(), n - stop


def pairs(cut: np.ndarray, at: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows that meet, about ``step`` pairs at once: all pairs of one chunk, or those across two."""
    n, size = int(cut[-1]), np.diff(cut)
    lo, hi, own = at >> 2 * _BITS, at >> _BITS & _LOW, at & _LOW
    one, first = lo == hi, own == lo
    # rows of the first chunk come first
    across = np.repeat(cut[:-1] + np.add.reduceat(first.astype(np.int64), cut[:-1]), size)
    start = np.where(one, np.arange(n) + 1, across)
    count = np.where(first, np.repeat(cut[1:], size) - start, 0)
    total, i = np.cumsum(count), 0
    while i < n:
        stop = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + step, "right")))
        own_count = count[i:stop]
        yield np.repeat(np.arange(i, stop), own_count), np.arange(own_count.sum()) + np.repeat(start[i:stop] - np.cumsum(own_count) + own_count, own_count)
        i = stop

"""Suffix-array dedup (operator 5): remove bytes that W-byte strings cover which also start earlier in the corpus.

The corpus is too large for one suffix array, so ``repeats`` first brings all copies of a window together under an
anchor; identical segments are settled there, and the segments of an anchor that differ come here, to a suffix array
of a few whole groups. Its longest-previous-factor array is needed only through LPF >= W: among the suffixes whose
first W bytes agree (a run of suffix order), a previous or next smaller text position is an earlier match.

Nulls: a null text is empty. A null doc_id comes before all others; rows with equal ids are separate documents ordered
by their text (of equal texts, ties, all but one lose what they share). Documents under W bytes lose nothing. An
empty table gives an empty result. Texts of any length are read whole; a task holds one long text and its hashes.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import keyed
from strata.llm.repeats import Repeats, byte_tokens, covered, merged, texts_of

WINDOW, GRAM = 100, 24


def previous_factors(window: int, group, key, pos, segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged ranges of the suffixes with LPF >= window among the segments, text order being (key, position)."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    text = np.concatenate(segments).astype(np.int64)
    n, base = len(text), np.concatenate(([0], np.cumsum(size)[:-1]))
    end = np.repeat(base + size, size)
    here = np.arange(n)
    rank, have = text, 1
    while have < window:  # prefix doubling up to the window
        step = min(have, window - have)
        at = here + step
        after = np.where(at < end, rank[np.minimum(at, n - 1)] + 1, 0)
        both = rank * (int(rank.max()) + 2 if n else 1) + after
        order = np.argsort(both)
        new = np.concatenate(([0], np.cumsum(both[order][1:] != both[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        have += step
    whole = np.flatnonzero(here + window <= end)
    if not len(whole):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    owner = np.repeat(np.arange(len(segments)), size)[whole]
    k, p = key[owner], pos[owner] + whole - base[owner]
    order = np.lexsort((p, k))
    place = np.empty(len(whole), np.int64)
    place[order] = np.concatenate(([0], np.cumsum((k[order][1:] != k[order][:-1]) | (p[order][1:] != p[order][:-1]))))
    suffixes = np.argsort(rank[whole], kind="stable")
    run, value, wide = rank[whole][suffixes], place[suffixes], len(whole) + 1
    # previous and next smaller values inside a run: minima that start anew with every run
    before = np.minimum.accumulate(value - run * wide)
    behind = np.minimum.accumulate((value + run * wide)[::-1])[::-1]
    earlier = np.zeros(len(whole), bool)
    earlier[suffixes] = (before < value - run * wide) | (behind < value + run * wide)
    hit = order[earlier[order]]
    return merged(k[hit], p[hit], p[hit] + window)


def with_ranges(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """docs (row_key, text and others) with ``starts`` and ``stops``: the tokens covered, as int arrays or null."""
    found = repeats.marks(docs).groupBy("key").agg(F.collect_list(F.struct("pos", "stop")).alias("r"))
    return docs.join(found, F.col("row_key") == F.col("key"), "left").drop("key")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): per row; kept holds the remaining bytes."""
    rows = keyed(docs.select(id_col, F.col(text).alias("text")), id_col, "text")
    repeats = Repeats(window, gram, True, byte_tokens, partial(previous_factors, window), as_bytes=True)

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            ranges = b.column(2)
            for i, j, data, offsets in texts_of(b.column(1)):
                for d in range(i, j):
                    own = data[offsets[d - i] : offsets[d - i + 1]]
                    gone = spans = 0
                    if ranges[d].is_valid:
                        start, stop = covered(*(ranges[d].values.field(f).to_numpy() for f in (0, 1)))
                        keep = np.ones(len(own), bool)
                        for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                            keep[s:e] = False
                        gone, spans, own_kept = int((stop - start).sum()), len(start), own[keep]
                    else:
                        own_kept = own
                    for c, v in zip(cols, (len(own), gone, spans, own_kept.tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return with_ranges(rows, repeats).select(id_col, "text", "r").mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()

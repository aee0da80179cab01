"""Repeated windows of tokens across a corpus: the candidate search under operators 5 and 9.

A window is W consecutive tokens of one document. Winnowing picks, in every window, the leftmost smallest hash of its
K-token grams (an anchor); equal windows hold equal anchors at equal offsets, so all copies of a window meet under the
key of one anchor. An anchor's segment is the union of the windows that hold it.

1. Map: whole documents to (anchor, segment hash, row key, position), about one row per (W-K)/2 tokens. Copies of a
   segment inside a batch are settled there (a combiner), so a hot passage costs a row per batch, not per document.
2. Reduce, streamed in sorted order: copies of a segment are settled; segments of an anchor that differ are requests.
3. Requests are joined to their documents, the segments cut out, regrouped by anchor and handed to ``resolve``, which
   returns the repeated windows inside the group (a suffix array for bytes, suffix automata for words).

Skew: anchors with many different contexts in any batch (``hot``, a set bounded by 2/HOT_SHARE per anchor of a
document) are dealt by segment instead of anchor, and groups over WIDE members are compared window by window through
a hash of the whole window, so neither is one task's. Nothing is capped or dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, partitions

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: An anchor is hot when it stands in this share of a batch's documents with different contexts (8 at least).
HOT_SHARE, HOT_LEAST = 1 / 128, 8
WIDE = 512
#: Bytes of text handled at once, and bytes of a document's power table.
PART = 1 << 20
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD_TABLE = _TABLE.copy()
_FOLD_TABLE[65:91] = _TABLE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

MARK, ANCHOR, HOT, REQUEST, WIDE_REQUEST = range(5)
ROWS = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("s", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("stop", pa.int32())])
_DDL = "kind int, h long, s long, key long, pos int, stop int"
_powers: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, PART + 4096), INVERSE if inverse else BASE, np.uint64)
        have[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spread(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the token ranges [start, stop)."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix), True)[start] + (stop - start).astype(np.uint64) * BASE)


def prefixes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), False), out=out[1:])
    return out


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the tokens, one a byte, and the documents' bounds among them."""
    return _TABLE[data], offsets


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words among the bytes, and the documents' bounds among the words."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = gap[1:] != gap[:-1]
    begins, ends = edge & ~gap[1:], edge & ~gap[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut = inner[~gap[inner] & ~gap[inner + 1]]  # a word that would run on into the next document
    begins[cut] = ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, stops, bounds = word_spans(data, offsets)
    return spread(prefixes(_TABLE[data]), starts, stops) | np.uint64(1), bounds


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about PART bytes; a null is empty."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + PART, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the number of rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.ones(n + 1, bool)
    new[1:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


@dataclass(frozen=True)
class Repeats:
    """W, K: tokens of a window and of an anchor. first_stays: the earliest copy isn't repeated, else all copies are.

    tokens: (bytes, offsets) to token values and bounds. resolve: (group, key, position, token values) of the segments
    of a few whole groups to the (key, start, stop) found repeated.
    """

    window: int
    gram: int
    first_stays: bool
    tokens: Callable
    resolve: Callable
    as_bytes: bool = False

    def anchors(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, segment hash, key, start, stop) of the documents' segments; start and stop within the document."""
        w, k = self.window, self.gram
        values, bounds = self.tokens(data, offsets)
        n, span = len(values), w - k + 1
        none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        if n < w:
            return none
        prefix = prefixes(values)
        gram = spread(prefix, np.arange(n - k + 1), np.arange(k, n + 1))
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        have, size = low, 1
        while size < span:
            more = min(size, span - size)
            have = np.minimum(have[:-more], have[more:])
            size += more
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = bounds[1:][doc[: n - w + 1]] >= np.arange(w, n + 1)
        at = (have[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(at):
            return none
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        of = doc[at]
        start, stop = np.maximum(bounds[of], at + k - w), np.minimum(bounds[of + 1], at + w)
        return gram[at], spread(prefix, start, stop), keys[of], start - bounds[of], stop - bounds[of]

    def _anchored(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        keys = batch.column(0).to_numpy()
        parts = [self.anchors(keys[i:j], data, off) for i, j, data, off in texts_of(batch.column(1))]
        return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []

    def hot(self, docs: DataFrame) -> np.ndarray:
        """Anchors that stand in many different contexts."""

        def run(batches):
            for b in batches:
                if not b.num_rows or not (cols := self._anchored(b)) or not len(cols[0]):
                    continue
                a = self._distinct(cols[0], cols[1])
                cut = group_starts(a)
                n = np.diff(cut)
                big = n >= max(HOT_LEAST, b.num_rows * HOT_SHARE)
                yield pa.RecordBatch.from_arrays([pa.array(a[cut[:-1]][big].view(np.int64)), pa.array(n[big])], ["h", "n"])

        found = docs.select("row_key", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        total = docs.count()
        rows = found.where(F.col("n") >= max(HOT_LEAST, total * HOT_SHARE / 2)).select("h").toArrow()
        return np.sort(rows.column(0).to_numpy().view(np.uint64))

    @staticmethod
    def _distinct(a: np.ndarray, s: np.ndarray) -> np.ndarray:
        order = np.lexsort((s, a))
        a, s = a[order], s[order]
        return a[group_starts(a, s)[:-1]]

    def _settle(self, cols: dict[str, np.ndarray], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of runs of equal segments, sorted by key and position: which rows are repeated, which one stands for the run."""
        size = np.diff(cut)
        first = np.zeros(len(cols["h"]), bool)
        first[cut[:-1]] = True
        if self.first_stays:
            return ~first, first
        return np.repeat(size > 1, size), first

    def _map(self, docs: DataFrame, hot: np.ndarray) -> DataFrame:
        def run(batches):
            for b in batches:
                if not b.num_rows or not (cols := self._anchored(b)) or not len(cols[0]):
                    continue
                h, s, key, start, stop = cols
                is_hot = np.isin(h, hot)
                h = np.where(is_hot, mix(h ^ s), h)
                kind = np.where(is_hot, HOT, ANCHOR).astype(np.int32)
                order = np.lexsort((start, key, s, h))
                x = {"kind": kind[order], "h": h[order], "s": s[order], "key": key[order], "pos": start[order], "stop": stop[order]}
                repeated, first = self._settle(x, group_starts(x["h"], x["s"]))
                # a run's first row goes on; it is marked here only if it is known to be repeated
                n_marks = int(repeated.sum())
                out = {c: np.concatenate([v[repeated], v[first]]) for c, v in x.items()}
                out["kind"][:n_marks] = MARK
                out["h"][:n_marks] = mix(out["key"][:n_marks].view(np.uint64))
                yield _batch(out)

        return docs.select("row_key", "text").mapInArrow(run, _DDL)

    def _reduce(self, rows: DataFrame) -> DataFrame:
        """Marks and requests from sorted rows; a group may go over many Arrow batches."""

        def run(batches):
            seen = _Tail()
            for x in _columns(batches):
                yield from self._group(x, seen)
            yield from self._group(None, seen)

        return rows.mapInArrow(run, _DDL)

    def _group(self, x: dict[str, np.ndarray] | None, tail: _Tail) -> Iterator[pa.RecordBatch]:
        x = tail.join(x)
        if x is None or not len(x["h"]):
            return
        marks = x["kind"] == MARK
        out = [{c: v[marks] for c, v in x.items()}]
        x = {c: v[~marks] for c, v in x.items()}
        if len(x["h"]):
            repeated, first = self._settle(x, group_starts(x["h"], x["s"]))
            out.append({c: v[repeated] for c, v in x.items()} | {"kind": np.full(int(repeated.sum()), MARK, np.int32)})
            r = {c: v[first] for c, v in x.items()}
            cut = group_starts(r["h"])
            size = np.repeat(np.diff(cut), np.diff(cut))
            kind = np.where((r["kind"] == HOT) | (size > WIDE), WIDE_REQUEST, REQUEST).astype(np.int32)
            ask = (r["kind"] == HOT) | (size > 1)
            out.append({c: v[ask] for c, v in (r | {"kind": kind}).items()})
        for o in out:
            if len(o["h"]):
                yield _batch(o)

    def marks(self, docs: DataFrame) -> DataFrame:
        """(key, pos, stop): ranges of tokens of the documents (row_key, text) that repeated windows cover."""
        spark = docs.sparkSession
        docs = docs.select("row_key", "text").where("row_key is not null")
        n = partitions(spark)
        rows = self._map(docs, self.hot(docs))
        found = materialize(self._reduce(rows.repartition(n, "h").sortWithinPartitions("h", "s", "key", "pos")))
        asked = found.where(F.col("kind") >= REQUEST).groupBy("key").agg(F.collect_list(F.struct("kind", "h", "pos", "stop")).alias("asked"))
        cut = docs.join(asked, F.col("row_key") == F.col("key")).select("key", "text", "asked").mapInArrow(self._cut, "kind int, h long, key long, pos int, stop int, segment binary")
        late = cut.repartition(n, "h").sortWithinPartitions("kind", "h", "key", "pos").mapInArrow(self._resolve, "key long, pos int, stop int")
        return found.where(F.col("kind") == MARK).select("key", "pos", "stop").union(late)

    def _cut(self, batches):
        w = self.window
        for b in batches:
            keys, asked = b.column(0).to_pylist(), b.column(2)
            out: dict[str, list] = {c: [] for c in ("kind", "h", "key", "pos", "stop", "segment")}
            wide: list[tuple] = []
            for i, j, data, offsets in texts_of(b.column(1)):
                values, bounds = self.tokens(data, offsets)
                prefix = None
                for d in range(i, j):
                    own = (data if self.as_bytes else values)[bounds[d - i] : bounds[d - i + 1]]
                    flat = asked[d].values
                    kind, h, pos, stop = (flat.field(f).to_numpy() for f in range(4))
                    order = np.lexsort((pos, h, kind))
                    kind, h, pos, stop = kind[order], h[order], pos[order], stop[order]
                    # segments of a group that overlap in a document are one stretch of it
                    new = np.ones(len(h), bool)
                    new[1:] = (kind[1:] != kind[:-1]) | (h[1:] != h[:-1]) | (pos[1:] > stop[:-1])
                    at = np.flatnonzero(new)
                    kind, h, pos, stop = kind[at], h[at], pos[at], np.maximum.reduceat(stop, at)
                    narrow = kind == REQUEST
                    for c, v in (("kind", kind), ("h", h), ("pos", pos), ("stop", stop)):
                        out[c] += v[narrow].tolist()
                    out["key"] += [keys[d]] * int(narrow.sum())
                    out["segment"] += [own[p:s].tobytes() for p, s in zip(pos[narrow].tolist(), stop[narrow].tolist(), strict=True)]
                    if not narrow.all():
                        prefix = prefixes(values) if prefix is None else prefix
                        base = int(bounds[d - i])
                        p = np.unique(np.concatenate([np.arange(a, z - w + 1) for a, z in zip(pos[~narrow].tolist(), stop[~narrow].tolist(), strict=True)]))
                        wide.append((spread(prefix, p + base, p + base + w), np.full(len(p), keys[d], np.int64), p))
            yield pa.RecordBatch.from_arrays([pa.array(out["kind"], pa.int32()), pa.array(out["h"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["pos"], pa.int32()), pa.array(out["stop"], pa.int32()), pa.array(out["segment"], pa.binary())], list(out))
            if wide:
                h, key, pos = (np.concatenate(x) for x in zip(*wide, strict=True))
                order = np.lexsort((pos, key, h))
                h, key, pos = h[order], key[order], pos[order]
                start = group_starts(h)[:-1]
                count = np.diff(np.append(start, len(h)))
                # a combiner: of the copies in the batch, the first and the second (which proves a repeat) go on; the others are repeats for sure
                rank = np.arange(len(h)) - np.repeat(start, count)
                sure = rank >= 2
                kind = np.where(sure, MARK, WIDE_REQUEST).astype(np.int32)
                empty = pa.array([None] * len(h), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.where(sure, mix(h ^ key.view(np.uint64)), h).view(np.int64)), pa.array(key), pa.array(pos.astype(np.int32)), pa.array((pos + w).astype(np.int32)), empty], list(out))

    def _resolve(self, batches):
        """Sorted by kind, then h: marks, then segments (narrow groups), then windows by their hash."""
        tail, names = _Tail(by="h"), ["key", "pos", "stop"]
        held: list = []
        for x in itertools.chain(_columns(batches), [None]):
            x = tail.join(x)
            if x is None or not len(x["h"]):
                continue
            pick = lambda m, y=x: {c: v[m] for c, v in y.items()}
            sure, narrow, wide = (pick(x["kind"] == k) for k in (MARK, REQUEST, WIDE_REQUEST))
            if len(sure["h"]):
                yield pa.RecordBatch.from_arrays([pa.array(sure[c]) for c in names], names)
            if len(wide["h"]):
                repeated, _ = self._settle(wide, group_starts(wide["h"]))
                yield pa.RecordBatch.from_arrays([pa.array(wide[c][repeated]) for c in names], names)
            if len(narrow["h"]):
                cut, size = group_starts(narrow["h"]), 0
                begin = 0
                for s, e in itertools.pairwise(cut.tolist()):
                    size += sum(map(len, narrow["segment"][s:e]))
                    if size > PART or e == cut[-1]:
                        part = {c: v[begin:e] for c, v in narrow.items()}
                        key, pos, stop = self.resolve(part["h"], part["key"], part["pos"].astype(np.int64), [np.frombuffer(t, np.uint8 if self.as_bytes else np.uint64) for t in part["segment"]])
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(pos, pa.int32()), pa.array(stop, pa.int32())], names)
                        begin, size = e, 0


class _Tail:
    """Keeps the last, perhaps unended group of sorted rows back until the next rows come."""

    def __init__(self, by: str = "h"):
        self.by, self.held = by, None

    def join(self, x: dict[str, np.ndarray] | None) -> dict[str, np.ndarray] | None:
        if self.held is not None:
            x = self.held if x is None else {c: np.concatenate([v, x[c]]) for c, v in self.held.items()}
            if x is self.held:
                self.held = None
                return x
        if x is None or not len(x[self.by]):
            return None
        cut = int(np.flatnonzero(np.concatenate(([True], x[self.by][1:] != x[self.by][:-1])))[-1])
        self.held = {c: v[cut:] for c, v in x.items()}
        return {c: v[:cut] for c, v in x.items()}


def _columns(batches) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield {n: np.array(b.column(i).to_pylist(), object) if n == "segment" else b.column(i).to_numpy() for i, n in enumerate(b.schema.names)}


def _batch(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    types = {"h": np.int64, "s": np.int64, "key": np.int64, "pos": np.int32, "stop": np.int32, "kind": np.int32}
    return pa.RecordBatch.from_arrays([pa.array(x[c].view(t) if x[c].dtype == np.uint64 else x[c].astype(t)) for c, t in ((f.name, types[f.name]) for f in ROWS)], schema=ROWS)


def merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of equal length, sorted by key and start, as unions per key."""
    if not len(key):
        return key, start, stop
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(new)
    return key[at], start[at], stop[np.append(at[1:], len(key)) - 1]


def covered(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as disjoint, not touching, ascending ranges."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]

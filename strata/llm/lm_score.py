"""LM scoring (operator 2): stupid backoff over n-gram counts of the whole corpus, computed relationally.

S(w | c) = count(c w) / count(c) where the n-gram c w is in the count tables, else BACKOFF * S(w | shorter c), and
count(w) / N at last. The tables hold every word, and n-grams that occur MIN_COUNT times or more (a document's own
n-grams are counted, so one that is nowhere else is not evidence for itself). count(c) counts c as a context, that is
where a word follows it.

Documents are dealt to groups by hash (of GROUP documents or GROUP_BYTES of text). A group's distinct n-grams, counted
(the combiner), go to the bucket of their hash, of which there are as many as the corpus has n-grams by BUCKET. The
count table is partitioned by those buckets: where a bucket's rows meet, its part of the table is summed and joined to
the rows that asked, in one shuffle, since both sides are the same rows. The counts return to the group, which sums
the scores of its documents. Hot n-grams are one entry a group, and a task holds one bucket of one order at a time,
read in sorted order. An n-gram is a 64-bit hash, sorted and stored as differences, many to a row, in compressed byte
planes; count(c) travels as the few times c ends a document, and texts are compressed. What moves grows with the corpus, never with the square of anything.

Sums are of integers (millionths of a natural logarithm), so they don't depend on any order. Nulls: a null or empty
text has no words and score 0. Repeated ids are separate rows, and repeated texts score alike. An empty table gives an
empty result. Texts are read whole, a very long one as a group of its own. Only the id and the text are read, so other
columns may have any name.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import WORD, keyed, partitions
from strata.llm.repeats import _TABLE, group_starts, mix, prefixes, spread, texts_of, word_spans

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
GROUP, GROUP_BYTES, BUCKET = 2000, 8 << 20, 4 << 20
UNIT = 1e6
#: Bytes of a plane from which compressing it is tried.
LEAST_PLANE = 64
_SHORTEN, _LENGTHEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for n up to order (0 where the document has no such n-gram), and bounds."""
    starts, stops, bounds = word_spans(data, offsets)
    words = spread(prefixes(_TABLE[data]), starts, stops) | np.uint64(1)
    nth = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [words]
    for n in range(2, order + 1):
        h = np.zeros(len(words), np.uint64)
        h[1:] = mix(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) | np.uint64(1)
        h[nth < n - 1] = 0
        out.append(h)
    return out, bounds


def _pack(v: np.ndarray) -> bytes:
    """Whole numbers by byte planes: planes of zeros are left out, planes that zstd shortens are compressed."""
    planes = v.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    used = small = 0
    out = []
    for i in range(8):
        if not planes[i].any():
            continue
        used |= 1 << i
        raw = planes[i].tobytes()
        less = _SHORTEN.compress(raw) if len(raw) >= LEAST_PLANE else raw
        if len(less) + 4 < len(raw):
            small |= 1 << i
            raw = len(less).to_bytes(4, "little") + less
        out.append(raw)
    return bytes([used, small]) + b"".join(out)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes, at = np.zeros((n, 8), np.uint8), 2
    for i in range(8):
        if raw[0] >> i & 1:
            if raw[1] >> i & 1:
                size = int.from_bytes(raw[at : at + 4], "little")
                own, at = _LENGTHEN.decompress(raw[at + 4 : at + 4 + size]), at + 4 + size
            else:
                own, at = raw[at : at + n], at + n
            planes[:, i] = np.frombuffer(own, np.uint8)
    return planes.reshape(-1).view(np.uint64)


def _pack_sorted(h: np.ndarray) -> bytes:
    return _pack(np.diff(h, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n))


def _shorten(batches):
    """Texts go to their groups compressed; a null is an empty text."""
    for b in batches:
        yield b.set_column(2, "text", pa.array([_SHORTEN.compress(x or b"") for x in b.column(2).to_pylist()], pa.binary()))


def _distinct(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, weight = h[order], weight[order]
    cut = group_starts(h)[:-1]
    return h[cut], np.add.reduceat(weight, cut) if len(cut) else weight[:0]


def _own(table: pa.Table, order: int):
    """(first row, last row, n-gram hashes, bounds) of a group, chunk by chunk."""
    texts = pa.array([_LENGTHEN.decompress(x) for x in table.column("text").to_pylist()], pa.large_binary())
    for i, j, data, offsets in texts_of(texts):
        yield i, j, *grams(data, offsets, order)


def _tables(table: pa.Table, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the group's distinct n-grams, how often each occurs and how often it ends a document."""
    parts: list[list] = [[] for _ in range(order)]
    for _, _, gram, bounds in _own(table, order):
        ends = np.zeros(len(gram[0]), np.int64)
        ends[bounds[1:][np.diff(bounds) > 0] - 1] = 1
        for n, h in enumerate(gram):
            parts[n].append((h, ends))
    out = []
    for p in parts:
        h = np.concatenate([x for x, _ in p]) if p else np.zeros(0, np.uint64)
        ends = np.concatenate([x for _, x in p]) if p else np.zeros(0, np.int64)
        real = h != 0
        both, weight = _distinct(h[real], (np.int64(1) << 32) + ends[real])  # occurrences and ends in one sum; a group has fewer than 2^31 words
        out.append((both, weight >> 32, weight & 0xFFFFFFFF))
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """(id_col, n_words, n_backoff, score, mean_score): n_backoff counts the words scored below the full order."""
    spark = docs.sparkSession
    rows = keyed(docs.select(id_col, F.col(text).alias("text")), id_col, "text")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0)).alias("words")).first()
    corpus = size["words"]
    n_groups = max(1, size["n"] // GROUP, size["bytes"] // GROUP_BYTES)
    p = max(2 * partitions(spark), corpus * order // BUCKET)
    dealt = rows.select(F.pmod(F.xxhash64("row_key"), F.lit(n_groups)).alias("g"), id_col, F.col("text").cast("binary").alias("text"))
    dealt = dealt.mapInArrow(_shorten, dealt.schema)

    def ask(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("g", "n", "bucket", "size", "h", "counts", "ends")}
        g = table.column("g")[0].as_py()
        for n, (h, c, e) in enumerate(_tables(table, order)):
            at = np.searchsorted(h, _edges(p))
            for b in range(p):
                s = slice(at[b], at[b + 1])
                if s.stop > s.start:
                    for k, v in zip(out, (g, n, b, s.stop - s.start, _pack_sorted(h[s]), _pack(c[s]), _pack(e[s]) if n < order - 1 else None), strict=True):
                        out[k].append(v)
        _release()
        return pa.table({k: pa.array(v, pa.binary() if k in ("h", "counts", "ends") else pa.int64()) for k, v in out.items()})

    def answer(batches):
        rows_ = (x for b in batches for x in b.to_pylist())
        for (bucket, n), own in itertools.groupby(rows_, key=lambda x: (x["bucket"], x["n"])):
            own, context = list(own), n < order - 1
            h = np.concatenate([_unpack_sorted(x["h"], x["size"]) for x in own])
            table, place = np.unique(h, return_inverse=True)
            total, ends = (np.bincount(place, np.concatenate([_unpack(x[c], x["size"]) for x in own]), len(table)).astype(np.int64)[place] if c == "counts" or context else None for c in ("counts", "ends"))
            at = 0
            for x in own:
                s = slice(at, at + x["size"])
                at = s.stop
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((x["g"], pa.int64()), (n, pa.int64()), (bucket, pa.int64()), (x["size"], pa.int64()), (_pack(total[s]), pa.binary()), (_pack(ends[s]) if context else None, pa.binary()))], ["g", "n", "bucket", "size", "counts", "ends"])
            _release()

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        own, answers = _tables(left, order), right.to_pylist()
        found = []
        for n in range(order):
            mine = sorted((x for x in answers if x["n"] == n), key=lambda x: x["bucket"])
            c, ends = (np.concatenate([_unpack(x[k], x["size"]).astype(np.int64) for x in mine if x[k] is not None] or [np.zeros(0, np.int64)]) for k in ("counts", "ends"))
            f = c - ends if n < order - 1 else c
            if n:
                c = np.where(c < min_count, 0, c)  # not in the table
            found.append((own[n][0], c, f))
        count, back, total = (np.zeros(left.num_rows, np.int64) for _ in range(3))
        for i, j, gram, bounds in _own(left, order):
            size = len(gram[0])
            value, level = np.zeros(size, np.int64), np.full(size, -1)
            look = lambda n, h: np.minimum(np.searchsorted(found[n][0], h), max(0, len(found[n][0]) - 1))
            for n in range(order - 1, 0, -1):
                todo = np.flatnonzero((level < 0) & (gram[n] != 0))
                c = found[n][1][look(n, gram[n][todo])] if len(todo) else np.zeros(0, np.int64)
                todo, c = todo[c > 0], c[c > 0]
                context = found[n - 1][2][look(n - 1, gram[n - 1][todo - 1])] if len(todo) else c
                value[todo], level[todo] = np.rint(np.log(c / context * backoff ** (order - 1 - n)) * UNIT).astype(np.int64), n
            todo = np.flatnonzero(level < 0)
            if len(todo):
                c = found[0][1][look(0, gram[0][todo])]
                level[todo] = 0
                value[todo] = np.rint(np.log(c / corpus * backoff ** (order - 1)) * UNIT).astype(np.int64)
            cut = np.minimum(bounds[:-1], max(0, size - 1))
            full = np.diff(bounds) > 0
            for into, v in ((total, value), (back, (level < order - 1).astype(np.int64))):
                if size:
                    into[i:j] = np.where(full, np.add.reduceat(v, cut), 0)
            count[i:j] = np.diff(bounds)
        return pa.table({id_col: left.column(id_col), "n_words": pa.array(count), "n_backoff": pa.array(back), "score": pa.array(total / UNIT), "mean_score": pa.array(np.floor(total / np.maximum(count, 1) + 0.5) / UNIT)})

    asked = dealt.groupBy("g").applyInArrow(ask, "g long, n long, bucket long, size long, h binary, counts binary, ends binary")
    answered = asked.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "n").mapInArrow(answer, "g long, n long, bucket long, size long, counts binary, ends binary")
    kind = dict(docs.dtypes)[id_col]
    return dealt.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(sum_up, f"`{id_col}` {kind}, n_words long, n_backoff long, score double, mean_score double")


def _release() -> None:
    """Give back what Arrow keeps for later."""
    pa.default_memory_pool().release_unused()


def _edges(p: int) -> np.ndarray:
    """Bounds of p equal ranges of hashes."""
    return np.array([min((1 << 64) - 1, (i << 64) // p) for i in range(p)] + [(1 << 64) - 1], np.uint64)

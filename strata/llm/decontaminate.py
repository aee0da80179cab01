"""Benchmark decontamination (operator 4): every training passage is a BM25 query against an index of the test items.

Index: an inverted file of the items' terms with BM25 impacts, each item's divided by the score of the item's own text,
so one threshold means the same share of any item. Posting lists are cut into blocks with their largest impacts.
Retrieval: documents are cut into overlapping passages of WINDOW words (or twice the longest item), and block-max
WAND returns every item at SHARE of its own score or more. Items are numbered by their own scores and cut into BLOCKS
aligned blocks, so that the short items, which common words reach, share blocks. Which blocks can reach the threshold
at all, by the sums of the block maxima of a passage's distinct terms, is found for whole batches of passages at once;
a passage with such a block is searched by cursors in item order, with pivots and skips of blocks (Index.wand).
Verification: an item counts as leaked where VERIFIED of the question's and of the answer's word runs stand in the
passage. The last sentence is the answer (the last quarter of an item of one sentence), the rest the question.

Only shards of the items, of about SHARD_BYTES of text, are read by the driver and sent to the executors, one after
another; statistics are of all items and are made and joined by Spark. Words are runs of ASCII letters and digits and
bytes over 127, A-Z lower-cased.

Nulls: a null document or item has no words; an item without words leaks nowhere. Repeated ids are separate rows of
the input but one row of the result per (document id, item id), the best; of passages with equal scores (ties) the
one with the larger overlaps counts. Empty documents or items give an empty result. Whole texts are searched, however
long, about a megabyte of passages at a time. Ids may be of any type that can be sorted; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strata.llm.common import keyed, materialize, rest_of, tune
from strata.llm.repeats import _TABLE, group_starts, prefixes, spread, texts_of

WINDOW, SHARE, VERIFIED, K1, B = 128, 0.5, 0.5, 1.2, 0.75
BLOCKS, SHARD_BYTES = 32, 8 << 20
#: Block maxima are kept in single precision; bounds are tested this much lower.
SLACK = 1e-4
SCORES = ["score", "question_overlap", "answer_overlap"]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the texts' bounds among them."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = inside[1:] != inside[:-1]
    begins, ends = edge & inside[1:], edge & inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut = inner[inside[inner] & inside[inner + 1]]
    begins[cut] = ends[cut] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    return spread(prefixes(_TABLE[_FOLD[data]]), starts, stops), np.searchsorted(starts, offsets)


def _of(text: str) -> list[int]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return terms(raw, np.array([0, len(raw)]))[0].tolist()


def question_and_answer(text: str) -> tuple[list[int], list[int]]:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if _of(s)]
    if len(sentences) > 1:
        return _of(" ".join(sentences[:-1])), _of(sentences[-1])
    words = _of(text)
    n = -(-len(words) // 4)
    return words[: len(words) - n], words[len(words) - n :]


def overlap(part: list[int], passage: list[int], run: int = 3) -> float:
    """Share of the part's word runs (of ``run`` words, or all of a shorter part) that stand in the passage."""
    if not part:
        return 1.0
    run = min(run, len(part))
    grams = lambda w: {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    own = grams(part)
    return len(own & grams(passage)) / len(own)


class Index:
    """Inverted file of items: posting lists in item order, cut into blocks, with the largest impact of each block.

    Impacts are shares of an item's own score. ``item``, ``term`` and ``impact`` are rows, ``texts`` maps items to texts.
    """

    def __init__(self, texts: dict[int, str], item: np.ndarray, term: np.ndarray, impact: np.ndarray):
        keys, at = np.unique(item, return_inverse=True)
        total = np.bincount(at, impact)
        order = np.lexsort((keys, total))
        self.ids = keys[order].tolist()
        self.parts = [question_and_answer(texts[k]) for k in self.ids]
        self.longest = max(len(q) + len(a) for q, a in self.parts)
        self.wide = -(-len(keys) // BLOCKS)
        self.vocabulary, number = np.unique(term, return_inverse=True)
        place = np.argsort(order)[at]
        sort = np.lexsort((place, number))
        items, impacts, number = place[sort], (impact / total[at])[sort], number[sort]
        self.best = np.zeros((len(self.vocabulary), BLOCKS), np.float32)
        np.maximum.at(self.best, (number, items // self.wide), impacts.astype(np.float32))
        # where the postings of a term in a block begin
        self.begin = np.searchsorted(number * BLOCKS + items // self.wide, np.arange(len(self.vocabulary) * BLOCKS + 1)).astype(np.int32)
        self.items, self.impacts = items.tolist(), impacts.tolist()
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.low[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == words[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def live(self, passage: np.ndarray, number: np.ndarray, share: float):
        """Of sorted, distinct (passage, term number) pairs: passages and blocks whose maxima sum to the share, and where each passage's terms begin."""
        cut = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bound = np.add.reduceat(self.best[number], cut, axis=0)
        p, block = np.nonzero(bound >= share - SLACK)
        return p, block, np.append(cut, len(passage))

    def wand(self, query: np.ndarray, live: list[int], share: float):
        """(item number, score) of the items at the share or more: block-max WAND over the lists of the query's terms.

        Blocks are aligned, so in one block the lists' upper bounds are their maxima of that block, and blocks that
        aren't ``live`` are skipped whole. Cursors of the terms with postings in the block are kept in the order of
        their items. The pivot is the first item that the lists up to its cursor can lift to the share; without one
        the rest of the block is skipped. Cursors before the pivot move up to it; it is scored when all are there.
        """
        least = share - SLACK
        for block in live:
            cell = query * BLOCKS + block
            begin, end = self.begin[cell], self.begin[cell + 1]
            has = np.flatnonzero(end > begin)
            most = self.best[query[has], block].tolist()
            cursors = [(self.items[lo], m, lo, hi) for m, lo, hi in zip(most, begin[has].tolist(), end[has].tolist(), strict=True)]
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, -1
                for item, m, _, _ in cursors:
                    bound += m
                    if bound >= least:
                        pivot = item
                        break
                if pivot < 0:
                    break
                to = pivot
                if cursors[0][0] == pivot:
                    score = sum(self.impacts[at] for item, _, at, _ in cursors if item == pivot)
                    if score >= share:
                        yield pivot, score
                    to = pivot + 1
                moved = []
                for item, m, at, stop in cursors:
                    while at < stop and self.items[at] < to:
                        at += 1
                    if at < stop:
                        moved.append((self.items[at], m, at, stop))
                cursors = moved


def passages(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, stop) of windows that overlap by half and cover each document."""
    size = np.diff(bounds)
    step = window // 2
    count = np.where(size > 0, np.maximum(1, -(-(size - window) // step) + 1), 0)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + nth * step
    return doc, start, np.minimum(start + window, bounds[doc + 1])


def search(index: Index, words: np.ndarray, bounds: np.ndarray, share: float = SHARE, verified: float = VERIFIED, window: int = WINDOW):
    """(document, item number, score, question overlap, answer overlap) of the verified passages."""
    doc, start, stop = passages(bounds, max(window, 2 * index.longest))
    number = index.numbers(words)
    known = np.flatnonzero(number >= 0)
    lo, hi = np.searchsorted(known, start), np.searchsorted(known, stop)
    size = hi - lo
    own = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    if not len(own):
        return
    pairs = np.unique(np.repeat(np.arange(len(doc)), size) * len(index.vocabulary) + number[known[own]])
    passage, term = np.divmod(pairs, len(index.vocabulary))
    p, block, cut = index.live(passage, term, share)
    for k, own in itertools.groupby(zip(p.tolist(), block.tolist(), strict=True), key=lambda x: x[0]):
        at = int(passage[cut[k]])
        text = words[start[at] : stop[at]].tolist()
        for n, score in index.wand(term[cut[k] : cut[k + 1]], [b for _, b in own], share):
            q, a = (overlap(x, text) for x in index.parts[n])
            if q >= verified and a >= verified:
                yield int(doc[at]), n, score, q, a


def weighed(items: DataFrame) -> DataFrame:
    """(row_key, term, impact): BM25 impacts of the terms of items (row_key, text), by statistics of all items."""

    def run(batches):
        for b in batches:
            for i, _, data, offsets in texts_of(b.column(1)):
                words, bounds = terms(data, offsets)
                size = np.diff(bounds)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((words, doc))
                cut = group_starts(doc[order], words[order])
                first = order[cut[:-1]] if len(order) else order
                key = b.column(0).take(pa.array(i + doc[first]))
                yield pa.RecordBatch.from_arrays([key, pa.array(words[first].view(np.int64)), pa.array(np.diff(cut)), pa.array(size[doc[first]])], ["row_key", "term", "n", "length"])

    rows = materialize(items.select("row_key", "text").mapInArrow(run, "row_key long, term long, n long, length long"))
    size = rows.agg(F.countDistinct("row_key").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    often = rows.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    idf = F.log(1 + (size["items"] - F.col("often") + 0.5) / (F.col("often") + 0.5))
    mean = size["words"] / max(size["items"], 1)
    impact = idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / (mean or 1.0)))
    return materialize(rows.join(often, "term").select("row_key", "term", impact.alias("impact")))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, verified: float = VERIFIED, window: int = WINDOW) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap): each document's best passage for each item it leaks.

    Where both ids have one name, the item's is given as item_<name>.
    """
    spark = docs.sparkSession
    tune(spark)
    named = item_id if item_id != id_col else f"item_{item_id}"
    rows = keyed(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "item_id", "text").select("row_key", "item_id", "text")
    impacts = weighed(rows)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD_BYTES))
    mine = lambda shard: F.pmod(F.xxhash64("row_key"), F.lit(shards)) == shard
    slim, found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), None
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("item", LongType()), *(StructField(c, DoubleType()) for c in SCORES)])
    for shard in range(shards):
        part = impacts.where(mine(shard)).toArrow()
        if not part.num_rows:
            continue
        texts = {r["row_key"]: r["text"] for r in rows.where(mine(shard) & F.col("text").isNotNull()).select("row_key", "text").collect()}
        sent = spark.sparkContext.broadcast(Index(texts, *(part.column(c).to_numpy().view(t) for c, t in (("row_key", np.int64), ("term", np.uint64), ("impact", np.float64)))))

        def run(batches, sent=sent):
            for b in batches:
                index, out = sent.value, []
                for i, _, data, offsets in texts_of(b.column(1)):
                    words, bounds = terms(data, offsets)
                    out += [(i + d, index.ids[n], *x) for d, n, *x in search(index, words, bounds, share, verified, window)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["id", "item", *SCORES])

        leaks = slim.mapInArrow(run, schema)
        if shards > 1:  # one index at a time is held by the driver and the executors
            leaks = materialize(leaks)
            sent.destroy()
        found = leaks if found is None else found.union(leaks)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = found.join(rows.select(F.col("row_key").alias("item"), "item_id"), "item").groupBy("id", "item_id").agg(F.max(F.struct(*SCORES)).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(named), *[F.round(f"best.{c}", 6).alias(c) for c in SCORES])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents without a verified item; each row is judged by its own text, whatever its id."""
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), rest_of(docs.columns, text)), "id", "text")
    bad = contaminated(rows.select("row_key", "text"), items, "row_key", "text", **settings).select(F.col("row_key").alias("bad_key")).distinct()
    good = rows.join(bad, F.col("row_key") == F.col("bad_key"), "left_anti")
    return good.select(*[F.col("text").alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns])

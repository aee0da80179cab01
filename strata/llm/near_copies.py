"""Near copies by SimHash at a similarity (the pipeline's stage of operator 10): one document of each group stays.

At a Jaccard similarity of 0.8 on five-word shingles about 15 % of SimHash bits differ, too many for 64 bits and a
bound of 3. So the fingerprint has 256 bits (32 positional bytes, of which a pair at 0.8 shares nine on average), and
the inverted index is on pairs of positional bytes (PAIRS). Of the documents that meet in a list the shared positional
bytes are tallied, pairs with fewer than MIN_BYTES or over MAX_BITS dropped, and what remains is verified on the whole
shingle sets. Measured by simulation, an isolated pair at similarity 0.80 meets in some list with probability 0.95, at
0.85 with 0.985, at 0.9 with 0.998; the tally then drops less than one in a thousand of them, and verification is
exact but for 32-bit collisions of shingle hashes.

What is verified are families, the groups that pairs which pass the tally connect; pairs never leave a task,
only stars that span them. The first FIRST pairs of bytes name most of a large family, and the others
give only what connects different families, so the candidates grow with the documents however long a list is. Within
a family every document meets every other, chunk by chunk, on shingle sets; only stars of verified links are returned.

Scale: documents of equal fingerprints are one. Comparing grows with the square of a list (a 65,536th of the corpus
where documents are unlike) and of a family, both cut into chunk pairs; rows grow with a family's length times its
number of chunks.

Nulls: a null text is an empty one, and all empty texts are copies of one another. Repeated ids are separate rows; of
equal ids the first text stays. A pair at exactly the similarity is linked. An empty table gives an empty result.
Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import postings
from strata.llm.common import components, discard, keyed, materialize, rest_of
from strata.llm.repeats import _FOLD_TABLE, group_starts, mix, prefixes, spread, texts_of, word_spans

SHINGLE, SIMILARITY, WORDS64 = 5, 0.8, 4
PAIRS = [(i, (i + d) % 32) for d in (1, 3) for i in range(32)]
#: Pairs of bytes whose lists name the families; the others then look for links between families.
FIRST = 8
MIN_BYTES, MAX_BITS, CHUNK = 4, 72, 2048
#: Shingles of a chunk of a family. A family of at most SMALL documents is compared along with others.
SHINGLES, SMALL = 1 << 20, 16
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles (fewer words: of the whole sequence; none: empty)."""
    starts, stops, bounds = word_spans(data, offsets)
    words = spread(prefixes(_FOLD_TABLE[data]), starts, stops)
    prefix, size = prefixes(words), np.diff(bounds)
    out = []
    for b, k in zip(bounds[:-1].tolist(), size.tolist(), strict=True):
        at = np.arange(b, b + max(min(k, 1), k - n + 1))
        out.append(np.unique(spread(prefix, at, np.minimum(at + n, b + k))))
    return out


def wide_fingerprint(h: np.ndarray) -> bytes:
    """256 majority bits over a set of hashes."""
    if not len(h):
        return bytes(32)
    out = []
    for seed in _SEEDS:
        total = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            total += np.unpackbits(mix(h[i : i + (1 << 16)] ^ seed).view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(total * 2 > len(h), bitorder="little").tobytes())
    return b"".join(out)


def _candidates(classes: DataFrame, pairs: list[tuple[int, int]], count: int) -> DataFrame:
    """(a, b): stars that connect what passes the tally in the lists of the pairs of bytes; families where classes has them, else keys."""
    parts = [f"f{w}" for w in range(WORDS64)]
    name = "family" if "family" in classes.columns else "key"
    byte = lambda i: F.shiftrightunsigned(parts[i // 8], i % 8 * 8).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(n << 16).cast("long") + byte(i) * 256 + byte(j) for n, (i, j) in enumerate(pairs)])
    posting = classes.select(*dict.fromkeys(["key", name]), *parts, F.explode(keys).alias("list"))

    def run(batches):
        for table, cut, at in postings.blocks(batches, "list"):
            fp = [table.column(c).to_numpy().view(np.uint64) for c in parts]
            of = table.column(name).to_numpy()
            found = [(of[:0], of[:0])]
            for i, j in postings.pairs(cut, at):
                other = of[i] != of[j]
                i, j = i[other], j[other]
                differ = [w[i] ^ w[j] for w in fp]
                enough = np.flatnonzero(sum(postings.equal_bytes(d) for d in differ) >= MIN_BYTES)
                near = enough[sum(np.bitwise_count(d[enough]).astype(np.int64) for d in differ) <= MAX_BITS]
                found.append(postings.stars(of[i[near]], of[j[near]]))
            a, b = postings.stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = postings.dealt(posting, "list", "key", len(pairs) * count, CHUNK)
    return postings.gathered(dealt, "list").mapInArrow(run, "a long, b long").distinct()


def _families(classes: DataFrame) -> DataFrame:
    """(node, component) of the documents that have a candidate."""
    count = classes.count()
    first = materialize(_candidates(classes, PAIRS[:FIRST], count))
    named = materialize(components(first))
    labelled = classes.join(named, F.col("key") == F.col("node"), "left").select(*classes.columns, F.coalesce("component", "key").alias("family"))
    rest = materialize(_candidates(labelled, PAIRS[FIRST:], count))
    out = components(first.union(rest))
    for df in (first, named, rest):
        discard(df)
    return out


def alike(sets: list[np.ndarray], cut: np.ndarray, at: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sorted sets that meet (as in postings.pairs) and have at least the Jaccard similarity."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    out = [(np.zeros(0, np.int64),) * 2]

    def passing(i: np.ndarray, j: np.ndarray, both: np.ndarray) -> None:
        ok = both >= similarity * (size[i] + size[j] - both)
        out.append((i[ok], j[ok]))

    length = np.diff(cut)
    small = np.repeat(length <= SMALL, length)
    group = np.repeat(np.arange(len(length)), length)
    # small groups: pairs that share a shingle, of many groups at once
    own = np.repeat(np.arange(len(sets)), np.where(small, size, 0))
    if len(own):
        values = np.concatenate([s for s, few in zip(sets, small.tolist(), strict=True) if few])
        order = np.lexsort((own, values, group[own]))
        own = own[order]
        shared = group_starts(group[own], values[order])
        met = [(own[i] * len(sets) + own[j]) for i, j in postings.pairs(shared, np.zeros(len(own), np.int64))]
        pair, both = np.unique(np.concatenate(met), return_counts=True)
        i, j = np.divmod(pair, len(sets))
        # a group of two chunks is compared only across them
        lo, hi = at >> 42, at >> 21 & (1 << 21) - 1
        ok = (lo[i] == hi[i]) | (at[i] != at[j])
        passing(i[ok], j[ok], both[ok])
    for g in np.flatnonzero(length > SMALL).tolist():
        lo, hi = int(cut[g]), int(cut[g + 1])
        left = right = np.arange(lo, hi)
        if at[lo] != at[hi - 1]:
            left, right = left[at[lo:hi] == at[lo]], left[at[lo:hi] != at[lo]]
        both = _overlaps(sets[lo:hi], left - lo, right - lo)
        i, j = np.nonzero(both >= similarity * (size[left][:, None] + size[right][None, :] - both))
        ok = left[i] < right[j]
        out.append((left[i[ok]], right[j[ok]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, often: int = SMALL, cells: int = 1 << 24) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right: rare shingles pair by pair, the others by matrix products."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    own, cut = own[order], group_starts(values[order])
    length = np.diff(cut)
    place = [np.full(len(sets), -1) for _ in range(2)]
    for p, side in zip(place, (left, right), strict=True):
        p[side] = np.arange(len(side))
    out = np.zeros((len(left), len(right)), np.float32)
    rare = own[np.repeat((length > 1) & (length <= often), length)]
    bounds = np.concatenate(([0], np.cumsum(length[(length > 1) & (length <= often)])))
    for i, j in postings.pairs(bounds, np.zeros(len(rare), np.int64)) if len(rare) else ():
        for x, y in ((rare[i], rare[j]), (rare[j], rare[i])):
            ok = (place[0][x] >= 0) & (place[1][y] >= 0)
            np.add.at(out, (place[0][x[ok]], place[1][y[ok]]), 1)
    many = np.flatnonzero(length > often)
    for k in range(0, len(many), step := max(1, cells // len(sets))):
        these = many[k : k + step]
        holds = np.zeros((len(sets), len(these)), np.float32)
        for n, s in enumerate(these.tolist()):
            holds[own[cut[s] : cut[s + 1]], n] = 1
        out += holds[left] @ holds[right].T
    return out


def _linked(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): stars that span the links of every family, of (family, key, set)."""

    def run(batches):
        for table, cut, at in postings.blocks(batches, "family", 1 << 12):
            key = table.column("key").to_numpy()
            i, j = alike([np.frombuffer(x, np.uint32) for x in table.column("set").to_pylist()], cut, at, similarity)
            a, b = postings.stars(key[i], key[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = postings.dealt(sets, "family", "key", sets.count(), CHUNK, F.octet_length("set") / 4, SHINGLES)
    return postings.gathered(dealt, "family").select("family", "key", "set", "at").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs and ``is_first``: whether a row is the first of its group (by id, nulls first; then text).

    Groups are chains of verified links. A column is_first of docs is replaced; any other name may occur.
    """
    names = [c for c in docs.columns if c != "is_first"]
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), rest_of(names, text)), "id", "text")
    slim = rows.select(F.col("row_key").alias("key"), F.col("text"))

    parts = [f"f{w}" for w in range(WORDS64)]

    def print_(batches):
        for b in batches:
            raw = b"".join(wide_fingerprint(h) for _, _, data, offsets in texts_of(b.column(1)) for h in shingles(data, offsets, shingle))
            out = np.frombuffer(raw, np.int64).reshape(-1, WORDS64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, w]) for w in range(WORDS64))], ["key", *parts])

    prints = materialize(slim.mapInArrow(print_, "key long, f0 long, f1 long, f2 long, f3 long"))
    classes = materialize(prints.groupBy(*parts).agg(F.min("key").alias("key")))
    families = materialize(_families(classes))

    def sets(batches):
        for b in batches:
            out = [np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for _, _, data, offsets in texts_of(b.column(1)) for h in shingles(data, offsets, shingle)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(out, pa.binary())], ["family", "key", "set"])

    met = slim.join(families, F.col("key") == F.col("node")).select("key", "text", "component")
    own = materialize(met.mapInArrow(sets, "family long, key long, set binary"))
    links = materialize(_linked(own, similarity))
    member = components(links)
    for df in (own, families, links):
        discard(df)
    first = classes.join(member, F.col("key") == F.col("node"), "left").select(*parts, F.coalesce("component", "key").alias("first_key"))
    of = prints.join(first, parts).select(F.col("key").alias("print_key"), "first_key")
    met = rows.join(of, F.col("row_key") == F.col("print_key")).withColumn("is_first", F.col("row_key") == F.col("first_key"))
    return met.select(*[F.col("text").alias(c) if c == text else F.col("own").getField(c).alias(c) for c in names], "is_first")

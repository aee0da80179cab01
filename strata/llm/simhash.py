"""SimHash near-dedup (operator 10).

Fingerprints: 64 majority bits over the XXH64 of word shingles. Two fingerprints are linked when at most 3 bits
differ, so at least 5 of their 8 positional bytes are equal. The inverted index is on positional bytes, four at a
time: the 14 blocks of the Steiner system S(3,4,8) are such that every set of 5 byte positions holds exactly one
block whole, so any pair that shares 5 bytes meets in at least one posting list, while a list of one byte alone would
hold a 256th of the corpus. Of every pair that meets the shared positional bytes are tallied; pairs under the
guaranteed minimum are dropped, and only the others are compared bit by bit.

Scale: equal fingerprints collapse before indexing. A long posting list is cut into chunks and the chunk pairs are
dealt to different tasks, so no list is one task's; a task returns only stars that span the links it finds, so
the output grows with the rows, not with the square of a group.

Nulls: a null text is an empty one (fingerprint 0). Repeated ids are separate rows; a null id keeps its row, and
component_id, the smallest doc_id of the component, ignores nulls unless there is nothing else. A bit that is set in
exactly half of the hashes (a tie) is 0. An empty table gives an empty result. Whole texts are read however long they
are, 65,536 hashes at a time. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import postings
from strata.llm.common import components, discard, keyed, materialize, tune

BLOCKS = [c for c in itertools.combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MIN_BYTES, MAX_BITS = 5, 3
#: Entries of a posting list that one task compares with as many others.
CHUNK = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_of = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :]
    totals = np.zeros(64, np.int64)
    pairs = zip(starts[:n].tolist(), last.tolist(), strict=True)
    while part := list(itertools.islice(pairs, 65536)):
        h = np.fromiter([hash_of(joined[s:e], seed) for s, e in part], np.uint64, len(part))
        totals += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(totals * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(row_key, id_col, fp) per row; fp as a signed long."""
    rows = keyed(docs.select(id_col, text), id_col, text).select("row_key", id_col, text)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["row_key", id_col, "fp"])

    return rows.mapInArrow(run, f"row_key long, {id_col} {dict(docs.dtypes)[id_col]}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that span the components of the distinct fingerprints ``fp`` at MAX_BITS or fewer."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = F.array(*[F.lit(n).cast("long") * (1 << 32) + byte[p] + byte[q] * 256 + byte[r] * 65536 + byte[s] * 16777216 for n, (p, q, r, s) in enumerate(BLOCKS)])
    posting = fps.select("fp", F.explode(keys).alias("list"))

    def run(batches):
        for table, cut, at in postings.blocks(batches, "list"):
            fp = table.column("fp").to_numpy().view(np.uint64)
            found = [(fp[:0], fp[:0])]
            for i, j in postings.pairs(cut, at):
                differ = fp[i] ^ fp[j]
                enough = postings.equal_bytes(differ) >= MIN_BYTES
                near = np.flatnonzero(enough)[np.bitwise_count(differ[enough]) <= MAX_BITS]
                found.append(postings.stars(fp[i[near]], fp[j[near]]))
            a, b = postings.stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = postings.dealt(posting, "list", "fp", len(BLOCKS) * fps.count(), CHUNK)
    return postings.gathered(dealt, "list").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(row_key, id_col, fp, first_key, component_id) per row; first_key is the smallest row_key of the component."""
    tune(docs.sparkSession)
    fps = materialize(fingerprints(docs, id_col, text, shingle, seed))
    classes = materialize(fps.groupBy("fp").agg(F.min("row_key").alias("first_key"), F.min(id_col).alias("low")))
    edges = materialize(links(classes.select("fp")))
    member = components(edges)
    discard(edges)
    grouped = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = grouped.groupBy("component").agg(F.min("first_key").alias("first_key"), F.min("low").alias("component_id"))
    of = grouped.select("fp", "component").join(low, "component").select("fp", "first_key", "component_id")
    return fps.join(of, "fp")

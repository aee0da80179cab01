"""Token counts (operator 7): totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch is a set of signed changes: an insert adds a document and its tokens to a group, a delete takes them away, a
revised count (other text, other tokenizer version, corrected language) is a delete and an insert. A batch is summed
by group before it is written, so a hot source is a row per task. Its files are written first; it counts from the
moment its commit file names them, and the file is created only if it isn't there yet. So a batch that is sent again,
or by two drivers at once, counts once, as a commit file names one set of files. A driver lost before the commit, or
after it has created the file and before it has written the name into it, leaves nothing that counts: a file without a
whole name is no commit, and the next to send the batch replaces it. Totals are sums of the committed deltas.

Nulls: a null text has 0 tokens; a null source or language is a group of its own. Groups whose documents and tokens
are all taken away are not in the totals. Of equal texts (ties) the one with the smallest id, nulls first, is kept.
An empty table has no totals. Texts are tokenized whole. Other columns of documents may have any name.
"""

from __future__ import annotations

import base64
import os
import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import keyed, materialize, shared_dir, tune

#: Folder of vocabulary files; never copied into the repository.
TOKENIZERS = os.environ.get("STRATA_TOKENIZERS", "/opt/tokenizers")
#: Splitting pattern of the byte-level BPE vocabularies (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = ["source", "lang", "tokenizer"]
_encodings: dict[str, object] = {}
_WHOLE = re.compile("[0-9a-f]{32}")


def ranks(name: str, folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file, read where the driver is and sent to the executors (under 2 MB)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encoding(name: str, raw: bytes):
    if name not in _encodings:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[name]


def counted(docs: DataFrame, names: dict[str, object], text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """docs without text, and a column of token counts for each tokenizer; names maps it to the condition on rows that need it."""
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    files = {n: docs.sparkSession.sparkContext.broadcast(ranks(n, folder)) for n in names}
    slim = docs.select(*rest, text, *[F.coalesce(c, F.lit(False)).alias(f"need_{i}") for i, c in enumerate(names.values())])

    order = list(names)

    def run(batches):
        for b in batches:
            texts, out = b.column(len(rest)).to_pylist(), []
            for i, n in enumerate(order):
                need, e = b.column(len(rest) + 1 + i).to_pylist(), encoding(n, files[n].value)
                out.append(pa.array([len(e.encode_ordinary(t or "")) if ok else None for t, ok in zip(texts, need, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), *out], [*rest, *order])

    kinds = dict(docs.dtypes)
    return slim.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *(f"`{n}` long" for n in names)]))


def changes(counts: DataFrame, sign: int, tokenizer: str) -> DataFrame:
    """Signed changes of documents counted in the column ``tokenizer``."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col(tokenizer)).cast("long").alias("tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> dict[str, str]:
        """Batch name to folder of its deltas."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        found = {n: self._read(f"{self.folder}/commits/{n}") for n in names if not n.startswith(".")}
        return {bytes.fromhex(n).decode(): f"{self.folder}/deltas/{data}" for n, data in found.items() if _WHOLE.fullmatch(data)}

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Apply a batch of changes; False, and no effect, if a batch of this name was applied before."""
        key = batch.encode().hex()
        if batch in self.committed():
            return False
        data = uuid.uuid4().hex
        delta.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.folder}/deltas/{data}")
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        # created without overwriting: of two drivers at once, one wins
        claim = self._path(f"{self.folder}/commits/{key}")
        try:
            out = self._fs.create(claim, False)
        except Py4JJavaError:
            if batch in self.committed():
                return False
            if not self._fs.exists(claim):
                raise
            out = self._fs.create(claim, True)  # left by a driver that was lost before it wrote the name
        out.write(bytearray(data.encode()))
        out.close()
        return True

    def totals(self) -> DataFrame:
        ddl = "source string, lang string, tokenizer string, docs long, tokens long"
        paths = sorted(self.committed().values())
        rows = self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def corpus_rollup(docs: DataFrame, folder: str | None = None, first: str = "byte_bpe_50k", later: str = "byte_bpe_multi_50k") -> DataFrame:
    """Totals after three batches over documents (doc_id, text, lang, source), two of them sent twice.

    1. insert: every document, counted by the first tokenizer. 2. revise: documents whose language isn't ``en`` (or is
    null) are recounted by the later tokenizer. 3. delete: of equal texts all but the first are withdrawn.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")), "doc_id", "text").select("row_key", "source", "lang", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    moved = ~F.col("lang").eqNullSafe(F.lit("en"))
    counts = materialize(counted(rows, {first: F.lit(True), later: moved}))
    # the first of each text by partial minima; rows that aren't one of them go, joined by row and not by text
    first_rows = counts.groupBy("digest").agg(F.min("row_key").alias("kept")).select("kept")
    gone = counts.join(first_rows, F.col("row_key") == F.col("kept"), "left_anti")
    rollup = Rollup(spark, folder or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    batches = {
        "insert": changes(counts, 1, first),
        "revise": changes(counts.where(moved), -1, first).union(changes(counts.where(moved), 1, later)),
        "delete": changes(gone.where(~moved), -1, first).union(changes(gone.where(moved), -1, later)),
    }
    for name in ("insert", "revise", "insert", "delete", "delete"):
        rollup.commit(name, batches[name])
    return rollup.totals()

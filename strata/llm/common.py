"""Shared plumbing of the training-data operators: row keys, tables in the shared folder, links to components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the ASCII controls 0x09-0x0D. A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch. Python workers hold one batch of whole texts at a time, so this bounds their memory.
ARROW_ROWS = 1000
#: Folders of applications that name none (the setting can't be changed while one runs).
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, unless the user has chosen a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='strata-')}")
    return found.rstrip("/")


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, fixes what was drawn."""
    path = f"{shared_dir(df.sparkSession)}/strata-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later plan reads."""
    path = getattr(df, "_strata_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def rest_of(names: list[str], text: str):
    """All columns but the text as one struct (never an empty one), so that their names meet no name of ours."""
    spare = "one"
    while spare in {n.lower() for n in names}:
        spare += "_"
    return F.struct(*[F.col(f"`{c}`") for c in names if c != text], F.lit(1).alias(spare)).alias("own")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(rows: DataFrame, id_col: str, *content: str) -> DataFrame:
    """Add ``row_key``: a unique, never null long whose order is that of (id_col, nulls first; content; row).

    Where the ids are integers, never null and never repeated (the rule), the id itself serves and costs one
    aggregate over ids. Otherwise rows are sorted and numbered once, and the numbered table is written, so that a
    lost executor cannot renumber them.
    """
    tune(rows.sparkSession)
    if dict(rows.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        twice = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull())
        if twice.isEmpty():
            return rows.withColumn("row_key", F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    order = [F.col(c).asc_nulls_first() for c in (id_col, *content)]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("row_key", F.monotonically_increasing_id()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each keeps connectivity, and the edges become stars around the
    smallest nodes in a logarithmic number of rounds. A hub's edges are only ever aggregated (min) and joined on the
    hub, never collected; each round is written to the shared folder.
    """
    spark = edges.sparkSession
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    while True:
        # large star: every node hands its larger neighbours to the smallest node it knows
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # small star: every node hands its smaller neighbours to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialize(small)
        discard(cur)
        now = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        cur, done, sign = nxt, now == sign, now
        if done or not now["n"]:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

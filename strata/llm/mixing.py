"""Mixing sources to target weights (operator 3), in DataFrame and SQL functions only.

The words of a source form one axis, packed into blocks of BLOCK words. Output shards of SHARD slots draw how many
slots each source gets: the whole part of the expected count is given, the remainder is drawn from a multinomial over
the fractional parts (residual multinomial sampling: the expectation of a plain multinomial, a fraction of its
spread). Slot j of a source goes through the source's pseudorandom index permutation of epoch j div blocks
(swap-or-not rounds, a bijection of any number of blocks), and slots meet blocks by a join on the index. No block is
taken twice before all are taken once, so no document exceeds MOST times its size.

Scale: words are counted once, and the small table (id, source, size) is all that is read again. Positions on the axis
come from prefix sums in two levels, so a source with a third of all rows is many window groups. Nothing is broadcast
by hint, and randomness is a hash of (seed, source, shard, draw): reruns agree.

Nulls: a null text has size 0; null is a source of its own, after all others; a null id is a row like any other, and
so is each of repeated ids. Documents of size 0 take 0. Ties: rows of equal id and size are alike, so which of them
comes first doesn't matter to the result. An empty table gives an empty result. A long text is as many blocks as it
needs. Only the id, the text and the source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import WORD, materialize, partitions

BLOCK, SHARD, ROUNDS, SEED, MOST = 32, 65536, 16, 20240, 3
WEIGHTS = (5, 2, 1)
#: Cells of the unit interval, by which a draw finds its source.
CELLS = 1024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, ix, source_size, target): sources by code point, null last; weights repeat along them.

    Targets are least(most * size, level * weight) for the one level at which they sum to all sizes. Along sources
    sorted by the level at which they fill, level_i is what is left for the unfilled ones, and the largest holds.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.withColumn("ix", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ordered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("ix") % len(weights) + 1))
    fill = Window.orderBy(F.col("source_size") * most / F.col("weight"), "ix")
    over_all = Window.partitionBy()
    left = F.sum("source_size").over(over_all) - F.coalesce(F.sum(F.col("source_size") * most).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    return (
        weighed.withColumn("level", level)
        .withColumn("target", F.least((F.col("source_size") * most).cast("double"), F.max("level").over(over_all) * F.col("weight")))
        .select("source", "ix", "source_size", "target")
    )


def slot_counts(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(ix, shard, n, blocks): slots of each source in each output shard."""
    per = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    per = per.withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))
    over_all = Window.partitionBy()
    per = per.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(over_all) / shard)).cast("long"))
    # the small bias keeps an expected count that is whole but for rounding whole
    per = per.withColumn("mean", F.col("slots") / F.col("shards") + 1e-9).withColumn("sure", F.floor("mean").cast("long")).withColumn("rest", F.col("mean") - F.col("sure"))
    per = per.withColumn("all_rest", F.sum("rest").over(over_all)).withColumn("hi", F.sum("rest").over(Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("lo", F.col("hi") - F.col("rest"))
    sure = per.select("ix", "blocks", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.col("sure").alias("n"))
    uniform = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) / float(1 << 40)
    draws = (
        per.agg(F.max("shards").alias("shards"), F.max("all_rest").alias("all_rest"))
        .where("shards is not null")
        .select("all_rest", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        .withColumn("k", F.floor(F.col("all_rest") + uniform("shard")).cast("int"))
        .where("k > 0")
        .select("all_rest", "shard", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("draw"))
        .withColumn("at", uniform("shard", "draw") * F.col("all_rest"))
        .withColumn("cell", F.floor(F.col("at") / F.col("all_rest") * CELLS))
    )
    cells = per.where("rest > 0").select("ix", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.col("all_rest") * CELLS), F.floor(F.col("hi") / F.col("all_rest") * CELLS))).alias("cell"))
    drawn = draws.join(cells, "cell").where("at >= lo and at < hi").groupBy("ix", "blocks", "shard").agg(F.count(F.lit(1)).alias("n"))
    return sure.unionByName(drawn).groupBy("ix", "blocks", "shard").agg(F.sum("n").alias("n"))


def taken_blocks(counts: DataFrame, rounds: int = ROUNDS, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(ix, block, times) of the blocks that some slot takes."""
    order = Window.partitionBy("ix").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    slots = (
        counts.withColumn("first", F.sum("n").over(order) - F.col("n"))
        .where("n > 0")
        .repartition(partitions(counts.sparkSession), "ix", "shard")  # few rows, which become many
        .select("ix", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
        .where(F.col("slot") < F.col("blocks") * most)
        .withColumn("epoch", F.expr("slot div blocks"))
        .withColumn("x", F.col("slot") % F.col("blocks"))
    )
    other = f"pmod(pmod(xxhash64({seed}, ix, epoch, r), blocks) - x, blocks)"
    walk = f"aggregate(sequence(1, {rounds}), x, (x, r) -> if(xxhash64({seed}, epoch, ix, r, greatest(x, {other})) % 2 = 0, x, {other}))"
    return slots.select("ix", F.expr(walk).alias("block")).groupBy("ix", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(id_col, size, source_size, target, taken) per row; taken counts the words that the mix takes, repeats too."""
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")))
    buckets = 64 + sizes.count() // 4096
    sources = materialize(targets(sizes))
    times = taken_blocks(slot_counts(sources, block, shard, seed), seed=seed)
    of = sizes.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets))).join(sources, sizes["source"].eqNullSafe(sources["source"])).drop("source")
    totals = of.groupBy("ix", "bucket").agg(F.sum("size").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.partitionBy("ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inner = Window.partitionBy("ix", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        of.withColumn("row", F.row_number().over(Window.partitionBy("ix", "bucket").orderBy("id", "size")))
        .withColumn("upto", F.sum("size").over(inner))
        .join(base, ["ix", "bucket"])
        .withColumn("stop", F.col("base") + F.col("upto"))
        .withColumn("start", F.col("stop") - F.col("size"))
    )
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}")))
    pieces = placed.withColumn("block", F.explode_outer(span)).withColumn("words", F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    # Spark can't tell how many rows the slots are, and would broadcast them
    met = pieces.join(times.hint("merge"), ["ix", "block"], "left")
    whole = met.groupBy("ix", "bucket", "row", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return whole.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")

"""Embedding near-dedup (operator 8): NN-descent, then the threshold edges of the neighbour graph.

1. Equal vectors collapse to one node with a multiplicity.
2. Every node starts with its nearest among the nodes of a few random-hyperplane leaves; a leaf longer than LEAF is cut
   into chunks by hash, so a leaf of copies is not one task's.
3. Rounds of NN-descent: a node's list, the nodes that list it and the node itself meet (in parts of bounded size, so
   a hub is not one task's), and every pair there that beats a list's last entry joins that list. Rounds end when
   they bring hardly any new link.
4. A list whose last entry is still a link is saturated: links may be missing. Saturated nodes are covered by
   representatives, every node within the cover's radius and the threshold's angle of one meets the nodes that it
   covers, and links that leave a component join it with the other. Then degrees are counted over all nodes of a
   component, chunk by chunk, and only counts leave a task, so they are exact inside every component found.
5. Recall is audited on rows drawn by hash against all rows: the share of rows with links that have found all of
   theirs, of rows with few links and of rows with many, whichever is less. Rows are drawn until ENOUGH with few links
   are among them, or all are. Below RECALL the search goes on with longer lists, and where lists of 8 * NEIGHBOURS
   don't do, all nodes are compared with all, block by block.

Cosines are taken in double precision from the components as stored. Nulls: a vector that is null, empty, zero or
holds a null or non-finite component links with nothing. Vectors of different lengths don't link. Repeated ids are
separate rows; null ids are passed over in component_id unless there is nothing else. A cosine of exactly the
threshold (a tie) is a link. An empty table gives an empty result. Only the id and the vector are read, so other
columns may have any name.
"""

from __future__ import annotations

import itertools
import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import components, discard, keyed, materialize, partitions
from strata.llm.repeats import group_starts

THRESHOLD, NEIGHBOURS, LEAF, LEAVES, ROUNDS, PART, CHUNK = 0.95, 10, 256, 3, 6, 32, 1024
#: Representatives that are sent to the executors at once.
SHARD = 4096
#: Rows that the audit draws at first and at once at most; rows with few links that it needs.
AUDIT, MOST, ENOUGH, RECALL = 512, 8192, 64, 0.95
log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double) for each length of packed vector in a column."""
    packed = column.to_pylist()
    size = np.fromiter(map(len, packed), np.int64, len(packed))
    out = []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out.append((rows, _unpack([packed[i] for i in rows])))
    return out


def _unpack(packed: list[bytes]) -> np.ndarray:
    """Packed vectors of one length: a kind byte (f or d), then the components."""
    kind = np.float64 if packed[0][:1] == b"d" else np.float32
    x = np.frombuffer(b"".join(p[1:] for p in packed), kind).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """rows (row_key, vector) as (row_key, x): x is the packed vector, null where the row can't link."""
    double = "double" in dict(rows.dtypes)[vector]

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                v = b.column(1)[i]
                a = np.asarray(v.values, dtype=np.float64) if v.is_valid and not v.values.null_count else np.zeros(0)
                ok = len(a) and np.isfinite(a).all() and a.any()
                out.append((b"d" if double else b"f") + (a + 0.0).astype(np.float64 if double else np.float32).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["row_key", "x"])

    return rows.select("row_key", vector).mapInArrow(run, "row_key long, x binary")


def _leaf_codes(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits))
    return ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)


def _groups(batches, names: list[str]):
    """Whole groups (runs of equal ``names``) of sorted rows, as record batches' row ranges."""
    held = None
    for b in itertools.chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held is None:
            continue
        held = held.combine_chunks()
        cut = group_starts(*(held.column(n).to_numpy() for n in names))
        stop = len(cut) - 1 if b is None else len(cut) - 2
        for s, e in itertools.pairwise(cut[: stop + 1].tolist()):
            yield held.slice(s, e - s).combine_chunks().to_batches()[0]
        held = None if b is None else held.slice(int(cut[stop]))


def _edges(u, v, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y), t) for y, t in ((u, pa.int64()), (v, pa.int64()), (c, pa.float64()))], ["u", "v", "c"])


def _nearest(key: np.ndarray, x: np.ndarray, last: np.ndarray, k: int):
    """For each row, up to k of the others that are nearer than its last."""
    c = x @ x.T
    np.fill_diagonal(c, -2)
    c[key[:, None] == key[None, :]] = -2
    m = min(k, len(key) - 1)
    top = np.argpartition(-c, m - 1, axis=1)[:, :m] if m < len(key) - 1 else np.argsort(-c, axis=1)[:, :m]
    near = np.take_along_axis(c, top, axis=1)
    i, j = np.nonzero(near > np.maximum(last[:, None], -1.5))
    return key[i], key[top[i, j]], near[i, j]


def _local_join(names: list[str], k: int):
    def run(batches):
        out: tuple[list, list, list] = ([], [], [])
        for g in _groups(batches, names):
            key, last = g.column("row_key").to_numpy(), g.column("last").to_numpy()
            for rows, x in _matrix(g.column("x")):
                if len(rows) > 1:
                    for o, y in zip(out, _nearest(key[rows], x, last[rows], k), strict=True):
                        o.append(y)
            if len(out[0]) > 2000:
                yield _edges(*out)
                out = ([], [], [])
        if out[0]:
            yield _edges(*out)

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u, and nothing twice."""
    once = edges.groupBy("u", "v").agg(F.max("c").alias("c"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "v"))).where(F.col("n") <= k).drop("n")


def _leaves(bits: int) -> int:
    """How many leaves it takes that a pair at the threshold shares one with a probability of 0.95 (a plane parts it by its angle)."""
    share = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return max(LEAVES, math.ceil(math.log(0.05) / math.log1p(-share))) if share < 1 else LEAVES


def _start(nodes: DataFrame, total: int, k: int) -> DataFrame:
    bits = max(0, math.ceil(math.log2(max(total, 1) / LEAF)))
    count = _leaves(bits)

    def code(batches):
        for b in batches:
            for rows, x in _matrix(b.column("x")):
                part = b.take(pa.array(rows))
                for r in range(count):
                    leaf = _leaf_codes(x, bits, r) * count + r + x.shape[1] * (1 << 40)
                    yield pa.RecordBatch.from_arrays([part.column("row_key"), part.column("x"), pa.array(leaf)], ["row_key", "x", "leaf"])

    leaves = nodes.select("row_key", "x").mapInArrow(code, "row_key long, x binary, leaf long")
    size = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    dealt = leaves.join(size, "leaf").withColumn("part", F.pmod(F.xxhash64("row_key", "leaf"), F.ceil(F.col("n") / LEAF)))
    met = dealt.select("leaf", "part", "row_key", "x", F.lit(-2.0).alias("last")).repartition(partitions(nodes.sparkSession), "leaf", "part").sortWithinPartitions("leaf", "part")
    return _best(met.mapInArrow(_local_join(["leaf", "part"], k), "u long, v long, c double"), k)


def _refine(nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """One round of neighbours-of-neighbours."""
    last = graph.groupBy("u").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n"))
    known = nodes.join(last.withColumnRenamed("u", "row_key"), "row_key", "left").select("row_key", "x", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)).alias("last"))
    parts = graph.groupBy(F.col("v").alias("w")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    back = graph.join(parts, F.col("v") == F.col("w")).select("w", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.col("u").alias("a"))
    forth = graph.select(F.col("u").alias("w"), F.col("v").alias("a")).union(last.select(F.col("u").alias("w"), F.col("u").alias("a"))).join(parts, "w", "left")
    forth = forth.select("w", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)).alias("part"), "a")
    met = back.union(forth).distinct().join(known, F.col("a") == F.col("row_key")).select("w", "part", "row_key", "x", "last")
    new = met.repartition(partitions(nodes.sparkSession), "w", "part").sortWithinPartitions("w", "part").mapInArrow(_local_join(["w", "part"], k), "u long, v long, c double")
    return _best(graph.union(new), k)


def neighbour_graph(nodes: DataFrame, total: int, k: int = NEIGHBOURS, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, c): up to k approximate nearest neighbours of each node."""
    graph, links = materialize(_start(nodes, total, k)), None
    for _ in range(rounds):
        after = materialize(_refine(nodes, graph, k))
        discard(graph)
        graph, now = after, after.where(F.col("c") >= threshold).count()
        if links is not None and now <= links * 1.001:
            break
        links = now
    return graph


def _outside(nodes: DataFrame, graph: DataFrame, member: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): for each node, a link to a saturated node of each cover that it meets in another component."""
    spark, angle = nodes.sparkSession, math.acos(min(1.0, threshold))
    full = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold)).select("u")
    placed = nodes.select("row_key", "x").join(member, F.col("row_key") == F.col("node"), "left").select("row_key", "x", F.coalesce("component", "row_key").alias("component"))
    saturated = placed.join(full, F.col("row_key") == F.col("u"), "left_semi")
    size = saturated.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c"))
    dealt = saturated.join(size, "component").select("component", F.pmod(F.xxhash64("row_key"), F.col("c")).cast("int").alias("part"), "row_key", "x")

    def cover(batches):
        for g in _groups(batches, ["component", "part"]):
            key = g.column("row_key").to_numpy()
            for rows, x in _matrix(g.column("x")):
                rep, c, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.ones(len(rows), bool)
                while todo.any():
                    first = int(np.argmax(todo))
                    near = x @ x[first]
                    mine = todo & (near >= threshold)
                    mine[first] = True
                    rep[mine], c[mine], todo = first, near[mine], todo & ~mine
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(key[rows][rep]), pa.array(c)], ["covered", "rep", "near"])

    n = partitions(spark)
    covered = materialize(dealt.repartition(n, "component", "part").sortWithinPartitions("component", "part").mapInArrow(cover, "covered long, rep long, near double"))
    reps = covered.groupBy("rep").agg(F.min("near").alias("near"))
    count, found = reps.count(), None
    for shard in range(-(-count // SHARD)):
        own = reps.where(F.pmod(F.xxhash64("rep"), F.lit(-(-count // SHARD))) == shard).join(placed, F.col("rep") == F.col("row_key")).select("rep", "near", "x", "component").collect()
        if not own:
            continue
        sent = spark.sparkContext.broadcast(([r["rep"] for r in own], [r["near"] for r in own], [bytes(r["x"]) for r in own], [r["component"] for r in own]))

        def meet(batches, sent=sent):
            rep, near, packs, component = sent.value
            rep, component = np.array(rep), np.array(component)
            least = np.cos(np.minimum(np.pi, np.arccos(np.clip(near, -1, 1)) + angle)) - 1e-9
            theirs = _matrix(pa.array(packs, pa.binary()))
            for b in batches:
                key, of = b.column("row_key").to_numpy(), b.column("component").to_numpy()
                for rows, x in _matrix(b.column("x")):
                    for i, q in theirs:
                        if q.shape[1] == x.shape[1]:
                            v, r = np.nonzero((x @ q.T >= least[i]) & (of[rows][:, None] != component[i]))
                            yield pa.RecordBatch.from_arrays([pa.array(key[rows][v]), pa.array(rep[i][r])], ["v", "rep"])

        part = materialize(placed.mapInArrow(meet, "v long, rep long"))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "a long, b long")
    parts = found.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    asking = found.join(parts, "rep").select("rep", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("key"), F.lit(True).alias("asks"))
    asked = covered.join(parts, "rep").select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("covered").alias("key"), F.lit(False).alias("asks"))
    met = asking.union(asked).join(nodes.select(F.col("row_key").alias("key"), "x"), "key").select("rep", "part", "key", "asks", "x")

    def verify(batches):
        for g in _groups(batches, ["rep", "part"]):
            key, asks = g.column("key").to_numpy(), g.column("asks").to_numpy(zero_copy_only=False)
            for rows, x in _matrix(g.column("x")):
                a = asks[rows]
                hit = x[a] @ x[~a].T >= threshold
                i = np.flatnonzero(hit.any(axis=1))
                if len(i):
                    # what a node covers with it is of one component, so one link joins the two
                    yield pa.RecordBatch.from_arrays([pa.array(key[rows][a][i]), pa.array(key[rows][~a][hit[i].argmax(axis=1)])], ["a", "b"])

    return materialize(met.repartition(n, "rep", "part").sortWithinPartitions("rep", "part").mapInArrow(verify, "a long, b long"))


def _degrees(members: DataFrame, threshold: float) -> DataFrame:
    """(row_key, n): links of each of members (row_key, x, times, component) in its component, counting copies."""
    size = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("c"))
    dealt = (
        members.join(size, "component")
        .withColumn("own", F.pmod(F.xxhash64("row_key"), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "row_key", "x", "times")
    )

    def run(batches):
        for g in _groups(batches, ["component", "lo", "hi"]):
            key, times, first = g.column("row_key").to_numpy(), g.column("times").to_numpy(), g.column("own").to_numpy() == g.column("lo")[0].as_py()
            same = g.column("lo")[0] == g.column("hi")[0]
            n = np.zeros(len(key), np.int64)
            for rows, x in _matrix(g.column("x")):
                f = first[rows]
                if same:
                    hit = x @ x.T >= threshold
                    np.fill_diagonal(hit, False)
                    n[rows] += hit @ times[rows]
                else:
                    a, b = rows[f], rows[~f]
                    hit = x[f] @ x[~f].T >= threshold
                    n[a] += hit @ times[b]
                    n[b] += hit.T @ times[a]
            yield pa.RecordBatch.from_arrays([g.column("row_key"), pa.array(n)], ["row_key", "n"])

    n = partitions(members.sparkSession)
    counted = dealt.repartition(n, "component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(run, "row_key long, n long")
    return counted.groupBy("row_key").agg(F.sum("n").alias("n"))


def _compared(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that span the components of all links, and (row_key, n) as _degrees; every node meets every other."""

    def run(batches):
        for g in _groups(batches, ["lo", "hi"]):
            key, first = g.column("row_key").to_numpy(), g.column("own").to_numpy() == g.column("lo")[0].as_py()
            same = g.column("lo")[0] == g.column("hi")[0]
            for rows, x in _matrix(g.column("x")):
                a, b = (rows, rows) if same else (rows[first[rows]], rows[~first[rows]])
                hit = (x @ x.T if same else x[first[rows]] @ x[~first[rows]].T) >= threshold
                # the smallest node that each reaches in the block
                la, lb = key[a].copy(), key[b].copy()
                while hit.size:
                    top = np.iinfo(np.int64).max
                    ma = np.minimum(la, np.where(hit, lb[None, :], top).min(axis=1))
                    mb = ma if same else np.minimum(lb, np.where(hit, ma[:, None], top).min(axis=0))
                    if (ma == la).all() and (mb == lb).all():
                        break
                    la, lb = ma, mb
                for own, low in ((a, la),) if same else ((a, la), (b, lb)):
                    m = key[own] != low
                    yield pa.RecordBatch.from_arrays([pa.array(key[own][m]), pa.array(low[m])], ["a", "b"])

    c = max(1, -(-nodes.count() // CHUNK))
    every = nodes.select("row_key", "x", "times", F.lit(0).cast("long").alias("component"))
    dealt = (
        every.withColumn("own", F.pmod(F.xxhash64("row_key"), F.lit(c)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
        .select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "row_key", "x")
    )
    met = dealt.repartition(partitions(nodes.sparkSession), "lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(run, "a long, b long").distinct()
    return materialize(met), materialize(_degrees(every, threshold))


def audit(nodes: DataFrame, degrees: DataFrame, threshold: float = THRESHOLD, rows: int = AUDIT, enough: int = ENOUGH) -> float:
    """Share of the nodes with links that ``degrees`` (row_key, n) counts all links of: of those with at most NEIGHBOURS or of the others, whichever is less.

    Nodes are drawn by hash until ``enough`` with few links are among them, or all are.
    """
    parts, lo, step = max(1, -(-nodes.count() // rows)), 0, 1
    whole, seen = [0, 0], [0, 0]
    counted = nodes.join(degrees, "row_key", "left").select("row_key", "x", F.coalesce("n", F.lit(0)).alias("n"))
    while lo < parts and seen[0] < enough:
        asked = counted.where(F.pmod(F.xxhash64("row_key"), F.lit(parts)).between(lo, lo + step - 1)).collect()
        lo, step = lo + step, min(2 * step, max(1, MOST // rows))
        found = {r["row_key"]: r["n"] for r in asked}
        at, packs = np.array([r["row_key"] for r in asked], np.int64), [bytes(r["x"]) for r in asked]

        def run(batches, at=at, packs=packs):
            mine = [(i, x) for i, x in _matrix(pa.array(packs, pa.binary()))]
            for b in batches:
                key, times, n = b.column("row_key").to_numpy(), b.column("times").to_numpy(), np.zeros(len(at), np.int64)
                for rows_, x in _matrix(b.column("x")):
                    for i, q in mine:
                        if q.shape[1] == x.shape[1]:
                            n[i] += ((q @ x.T >= threshold) & (at[i][:, None] != key[rows_][None, :])) @ times[rows_]
                yield pa.RecordBatch.from_arrays([pa.array(at[n > 0]), pa.array(n[n > 0])], ["row_key", "n"])

        true = nodes.select("row_key", "x", "times").mapInArrow(run, "row_key long, n long").groupBy("row_key").agg(F.sum("n").alias("n")).collect() if asked else []
        for r in true:
            many = r["n"] > NEIGHBOURS
            seen[many] += 1
            whole[many] += found[r["row_key"]] >= r["n"]
    return min(w / n if n else 1.0 for w, n in zip(whole, seen, strict=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row."""
    rows = keyed(vectors.select(id_col, vector), id_col, vector)
    points = materialize(rows.select("row_key", id_col).join(packed(rows, vector), "row_key"))
    nodes = materialize(points.where("x is not null").groupBy("x").agg(F.min("row_key").alias("row_key"), F.min(id_col).alias("low"), F.count(F.lit(1)).alias("times")).select("row_key", "x", "low", "times"))
    total, k = nodes.count(), NEIGHBOURS
    while True:
        graph = neighbour_graph(nodes, total, k, threshold)
        links = materialize(graph.where(F.col("c") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")))
        member = materialize(components(links).where("node is not null"))
        outside = _outside(nodes, graph, member, k, threshold)
        if not outside.isEmpty():
            member = materialize(components(links.union(outside)).where("node is not null"))
        degrees = materialize(_degrees(nodes.join(member, F.col("row_key") == F.col("node")).select("row_key", "x", "times", "component"), threshold))
        recall = audit(nodes, degrees, threshold)
        log.info("rows with links that have all of theirs, by an audit, with lists of %d: %.4f", k, recall)
        if recall >= RECALL:
            break
        if k >= 8 * NEIGHBOURS:
            links, degrees = _compared(nodes, threshold)
            member = materialize(components(links).where("node is not null"))
            break
        k *= 2
    of = nodes.drop("x").join(member, F.col("row_key") == F.col("node"), "left").join(degrees, "row_key", "left").select("row_key", "low", "times", F.coalesce("component", "row_key").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    least = of.groupBy("component").agg(F.min("low").alias("component_id"))
    of = of.join(least, "component").select(F.col("row_key").alias("node"), "component_id", (F.col("n") + F.col("times") - 1).alias("links"))
    classes = nodes.select(F.col("row_key").alias("node"), "x").join(of, "node").select("x", "links", "component_id")
    out = points.join(classes, "x", "left").select(id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

"""The training-data operators against brute force, and on nulls, empty tables, repeats and odd columns."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import decontaminate, langid, lm_score, mixing, near_copies, neighbours, postings, queries, simhash, substring_dedup, suffix_dedup, token_counts, warc
from strata.llm.common import components, table

RNG = np.random.default_rng(5)
VOCABULARY = ["Lorem", "ipsum,", "dolor", "sit", "amet.", "ÉTÉ", "naïve", "x", "12", "ß"]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return [VOCABULARY[i] for i in RNG.integers(0, len(VOCABULARY), n)]


@pytest.fixture(scope="module")
def rows():
    base, passage = words(120), words(60)
    out = [
        (0, " ".join(base), "en", "a", 1),
        (1, " ".join(base[:90] + words(20)), "en", "a", 1),
        (2, "\t".join(words(30) + passage), "fr", "b", 1),
        (3, "\n ".join(passage + words(10)), "fr", None, 1),
        (4, None, None, "b", None),
        (5, "", "fr", "b", 0),
        (6, " ".join(base), None, "c", 1),
        (6, " ".join(base), None, "c", 1),
        (None, " ".join(words(45)), "en", "a", 1),
        (None, None, None, None, None),
        (7, "... 123 !!", "en", "a", 1),
        (8, "ab " * 120, "en", "a", 1),
        (9, "yx" * 4000, "en", "c", 1),
        (10, " ".join(words(3000)), "fr", "c", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    odd = ["row_key", "key", "r", "kept", "n_words", "fp", "node", "own", "id", "strata_one", "lang_pred"]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def ordered(rows):
    """Texts in the operators' row order: id (nulls first), then text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_suffix_dedup(docs, rows, none):
    seen, want = set(), Counter()
    for i, text, *_ in ordered(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        want[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    out = suffix_dedup.remove_repeats(docs).withColumn("kept", F.col("kept").cast("binary"))
    assert Counter((a, b, c, d, bytes(e)) for (a, b, c, d, e), n in got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept").items() for _ in range(n)) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(docs, rows, none, window):
    count = Counter()
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for _, w in texts:
        count.update(tuple(w[p : p + window]) for p in range(len(w) - window + 1))
    want = Counter()
    for i, w in texts:
        gone = [0] * len(w)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [1] * window
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    out = substring_dedup.remove_repeats(docs, window=window, gram=3)
    assert got(out, "doc_id", "n_words", "n_removed", "kept") == want
    assert set(docs.columns) <= set(out.columns)
    odd = substring_dedup.remove_repeats(docs.withColumn("a-b", F.lit(1)).withColumn("c.d e", F.lit(2)), window=window, gram=3) if window == 5 else out
    assert odd.count() == docs.count()
    assert substring_dedup.remove_repeats(none).count() == 0


def test_hot_and_wide_anchors(spark):
    """One line in many contexts: the paths for frequent anchors give the same result."""
    line = words(30)
    texts = [(i, " ".join(words(20) + line + words(20)), None, None, 1) for i in range(700)]
    df = spark.createDataFrame(texts, DDL)
    count = Counter()
    split = [(i, t.encode().split()) for i, t, *_ in texts]
    for _, w in split:
        count.update(tuple(w[p : p + 10]) for p in range(len(w) - 9))
    want = {}
    for i, w in split:
        gone = [0] * len(w)
        for p in range(len(w) - 9):
            if count[tuple(w[p : p + 10])] > 1:
                gone[p : p + 10] = [1] * 10
        want[i] = sum(gone)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, window=10, gram=4).collect()} == want


def test_simhash(docs, rows, none):
    def plain(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), seed=42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0

    fps = [(r[0], plain(r[1])) for r in rows]
    low, change = {f: f for _, f in fps}, True
    group = {f: i for i, (_, f) in enumerate(fps)}
    while change:
        change = False
        for f in low:
            for g in low:
                if (f ^ g).bit_count() <= 3 and group[f] != group[g]:
                    group[f] = group[g] = min(group[f], group[g])
                    change = True
    first = {}
    for i, f in fps:
        if i is not None:
            first[group[f]] = min(first.get(group[f], i), i)
    want = Counter((i, f, first.get(group[f])) for i, f in fps)
    out = simhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out.collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_long_posting_lists(spark, monkeypatch):
    """Chunk pairs of a long list find what one task would."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    base = int(RNG.integers(1 << 60))
    fps = sorted({base ^ sum(1 << int(b) for b in RNG.integers(0, 24, 3)) for _ in range(60)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    found = {r.node: r.component for r in components(edges).collect()}
    parent = {f: f for f in fps}
    for _ in fps:
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 3:
                    parent[f] = parent[g] = min(parent[f], parent[g])
    assert {f: found.get(f, f) for f in fps} == parent


def test_near_copies(spark, docs, none):
    base = words(400)
    near = base[:]
    near[200] = "changed"
    other = [" ".join(words(300)) for _ in range(20)]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base).upper().lower()), *((i + 10, t) for i, t in enumerate(other))]
    df = spark.createDataFrame([(i, f"{t} u{i}" if i > 9 else t, None, None, 1) for i, t in texts], DDL)
    kept = {r.doc_id for r in near_copies.near_copies(df).where("is_first").collect()}
    assert 1 in kept and 2 not in kept and {i + 10 for i in range(20)} <= kept
    assert near_copies.near_copies(docs).count() == docs.count()
    assert near_copies.near_copies(none).count() == 0


def test_near_copies_in_a_family(spark):
    """Real copies among many documents that are alike, but less than 0.8: all pairs that meet in the index count."""
    rng = np.random.default_rng(11)

    def changed(w, n):
        out = list(w)
        for i in rng.choice(len(w) // 5, n, replace=False) * 5 + 2:
            out[i] = f"n{rng.integers(1 << 40)}"
        return out

    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    family = [changed(base, 6) for _ in range(300)]
    texts = [" ".join(w) for w in family + [changed(w, 8) for w in family[:40]]]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], DDL)
    low, pairs = first_of(texts)
    assert sum(0.5 <= v < 0.8 for v in pairs.values()) > 40000 and sum(v >= 0.8 for v in pairs.values()) >= 40
    assert {r.doc_id for r in near_copies.near_copies(df).where("is_first").collect()} == set(low)


def first_of(texts, n=5, similarity=0.8):
    """For each text the first one that chains of pairs at the similarity lead to, and the pairs' similarities above 0, by brute force."""
    split = [t.split() for t in texts]
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set() for w in split]
    low, pairs = list(range(len(texts))), {}
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x == y or x & y:
                pairs[i, j] = len(x & y) / len(x | y) if x | y else 1.0
    near = [p for p, v in pairs.items() if v >= similarity]
    before = None
    while before != low:
        before = list(low)
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    return low, pairs


@pytest.mark.parametrize("few", [0, 16])
def test_alike_in_chunks(spark, monkeypatch, few):
    """Families of several chunks, compared with others or alone, link what brute force links."""
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    monkeypatch.setattr(near_copies, "SMALL", few)
    rng = np.random.default_rng(few)
    rows, want = [], []
    for family in range(12):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 1 << 32, 60, dtype=np.uint32), base)) for _ in range(3 * family + 1)]
        keys = [family * 100 + i for i in range(len(sets))]
        rows += [(family, k, bytearray(x.tobytes())) for k, x in zip(keys, sets)]
        want += [(k, m) for k, x in zip(keys, sets) for m, y in zip(keys, sets) if k < m and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))]
    low = {k: k for _, k, _ in rows}
    for _ in range(40):
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert 0 < len(want) and len(set(low.values())) > 12
    edges = near_copies._linked(spark.createDataFrame(rows, "family long, key long, set binary"), 0.8)
    found = {r.node: r.component for r in components(edges).collect()}
    assert {k: found.get(k, k) for k in low} == low


def test_stars_and_pairs():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 300, (2, 200))
    low = np.arange(300)
    for _ in range(300):
        for i, j in zip(a, b):
            low[i] = low[j] = min(low[i], low[j])
    node, root = postings.stars(a, b)
    got_low = np.arange(300)
    got_low[node] = root
    assert (got_low == low).all() and len(node) == len(set(node.tolist()))
    pair = lambda lo, hi, own: lo << 42 | hi << 21 | own
    at = np.array([0, 0, 0, pair(0, 2, 0), pair(0, 2, 0), pair(0, 2, 2), 0])
    met = [(i, j) for x, y in postings.pairs(np.array([0, 3, 6, 7]), at, 2) for i, j in zip(x.tolist(), y.tolist())]
    assert met == [(0, 1), (0, 2), (1, 2), (3, 5), (4, 5)]
    words_ = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    assert (postings.equal_bytes(words_[0] ^ words_[1]) == (words_[0].view(np.uint8) == words_[1].view(np.uint8)).reshape(-1, 8).sum(axis=1)).all()


def test_count_filter(spark):
    """Pairs under the guaranteed minimum of shared bytes are no candidates, pairs at three bits are links."""
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 0x10101, base ^ 0x1010101 << 16, base ^ 7]
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    assert found == {f: min(base, base ^ 0x10101, base ^ 7) for f in (base, base ^ 0x10101, base ^ 7)}


def test_language_gradients():
    net = langid.Network(["a", "b", "c"], 4)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, label, mask = RNG.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((5, 7))
    _, grad = net.gradients(x, label, mask)
    for k, w in net.weights.items():
        i = np.unravel_index(np.abs(grad[k]).argmax(), w.shape)
        old, losses = w[i], []
        for d in (1e-3, -1e-3):
            w[i] = old + d
            losses.append(net.gradients(x, label, mask)[0])
        w[i] = old
        assert math.isclose((losses[0] - losses[1]) / 2e-3, grad[k][i], rel_tol=1e-2)


def test_language_id(spark, sf_dir, docs, none):
    out = queries.op1_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred)[out.held_out].mean() > 0.9
    assert out.score.between(0, 1).all()
    odd = langid.identify(docs)
    assert {r.lang_pred for r in odd.where("text is null or text = '' or doc_id = 7").collect()} == {"und"}
    assert odd.count() == docs.count() and langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize(("order", "least"), [(1, 2), (2, 2), (3, 2), (3, 1), (4, 3)])
def test_lm_score(docs, rows, none, order, least):
    texts, c, f, n = [(r[0], (r[1] or "").encode().split()) for r in rows], Counter(), Counter(), 0
    for _, w in texts:
        n += len(w)
        for k in range(1, order + 1):
            for i in range(len(w) - k + 1):
                c[tuple(w[i : i + k])] += 1
                f[tuple(w[i : i + k])] += i + k < len(w)
    want = Counter()
    for i, w in texts:
        back = total = 0
        for k in range(len(w)):
            for size in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k + 1 - size : k + 1])
                if size == 1 or c[gram] >= least:
                    break
            back += size < order
            total += round(math.log(c[gram] / (f[gram[:-1]] if size > 1 else n) * 0.4 ** (order - size)) * 1e6)
        want[i, len(w), back, total] += 1
    out = lm_score.score(docs, order=order, min_count=least)
    assert Counter((r.doc_id, r.n_words, r.n_backoff, round(r.score * 1e6)) for r in out.collect()) == want
    assert lm_score.score(none, order=order).count() == 0


@pytest.mark.parametrize("high", [1, 2, 300, 1 << 40, (1 << 64) - 1])
def test_packed_numbers(high):
    for n in (0, 1, 63, 64, 5000):
        v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
        assert (lm_score._unpack(lm_score._pack(v), n) == v).all()
        v.sort()
        assert (lm_score._unpack_sorted(lm_score._pack_sorted(v), n) == v).all()


def test_mixing(spark, sf_dir, docs, none):
    out = mixing.mix(docs)
    assert out.count() == docs.count() and out.where("taken > 3 * size").count() == 0
    assert mixing.mix(none).count() == 0
    big = queries.op3_source_mix(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").toPandas()
    per = big.groupby("source").agg(size=("size", "sum"), same=("source_size", "max"), target=("target", "max"), taken=("taken", "sum")).sort_index()
    assert (per["size"] == per.same).all() and ((per.taken - per.target).abs() <= 0.02 * per.target + 64).all()
    weight = np.array([(5, 2, 1)[i % 3] for i in range(len(per))], float)
    target, open_ = np.zeros(len(per)), np.ones(len(per), bool)
    while True:  # reshare the excess by weight until none is above
        target[open_] = (per["size"].sum() - target[~open_].sum()) * weight[open_] / weight[open_].sum()
        over = open_ & (target > 3 * per["size"].to_numpy())
        if not over.any():
            break
        target[over] = 3 * per["size"].to_numpy()[over]
        open_ &= ~over
    assert np.allclose(target, per.target)
    again = queries.op3_source_mix(spark, sf_dir).toPandas()
    assert dict(zip(big.doc_id, big.taken)) == dict(zip(again.doc_id, again.taken))


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("w" + str(i) for i in rng.integers(0, 5000, n))
    items = [(i, f"{text(20)}. {text(8)}.") for i in range(30)] + [(98, None), (99, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = [(i, text(400), None, None, 1) for i in range(40)]
    leaky = [(100 + i, f"{text(150)} {items[i][1].upper()} {text(150)}", None, None, 1) for i in range(0, 30, 3)]
    df = spark.createDataFrame(plain + leaky, DDL)
    assert got(decontaminate.contaminated(df, bench), "doc_id", "item_id") == Counter((100 + i, i) for i in range(0, 30, 3))
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == set(range(40))
    assert decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_retrieval_by_brute_force(spark):
    """Block-max WAND retrieves what scoring every item for every passage does, with the same scores."""
    rng = np.random.default_rng(12)
    text = lambda n, v=300: " ".join("w" + str(int(i)) for i in v * rng.random(n) ** 3)
    items = [(i, f"{text(int(rng.integers(3, 30)))}. {text(int(rng.integers(1, 9)))}.") for i in range(150)]
    docs = [text(400) + " " + items[i][1] + " " + text(40) for i in range(0, 150, 2)]
    weights = decontaminate.weighed(spark.createDataFrame(items, "row_key long, text string")).toPandas()
    split = {i: t.replace(".", "").split() for i, t in items}
    often, mean = Counter(w for x in split.values() for w in set(x)), sum(map(len, split.values())) / len(split)
    idf = lambda w: math.log(1 + (len(items) - often[w] + 0.5) / (often[w] + 0.5))
    impact = lambda i, w: idf(w) * split[i].count(w) * 2.2 / (split[i].count(w) + 1.2 * (0.25 + 0.75 * len(split[i]) / mean))
    own = {i: sum(impact(i, w) for w in set(x)) for i, x in split.items()}
    assert np.isclose(sorted(weights.impact), sorted(impact(i, w) for i, x in split.items() for w in set(x))).all()
    index = decontaminate.Index(dict(items), weights.row_key.to_numpy(), weights.term.to_numpy().view(np.uint64), weights.impact.to_numpy())
    want, found, tested = set(), set(), 0
    for d, t in enumerate(docs):
        w = t.replace(".", "").split()
        for lo in range(0, max(1, len(w) - 128 + 64), 64):
            passage = set(w[lo : lo + 128])
            for i, x in split.items():
                score = sum(impact(i, y) for y in set(x) if y in passage) / own[i]
                tested += score >= 0.5
                q, a = (decontaminate.overlap(p, decontaminate._of(" ".join(w[lo : lo + 128]))) for p in decontaminate.question_and_answer(items[i][1])) if score >= 0.5 else (0, 0)
                if q >= 0.1 and a >= 0.1:
                    want.add((d, i, round(score, 9)))
        raw = np.frombuffer(t.encode(), np.uint8)
        words_, bounds = decontaminate.terms(raw, np.array([0, len(raw)]))
        found |= {(d, index.ids[n], round(score, 9)) for _, n, score, _, _ in decontaminate.search(index, words_, bounds, 0.5, 0.1, 128)}
    assert len(want) >= 75 and tested > 2 * len(want) and found == want


@pytest.mark.parametrize("kind", ["short", "decimal(9,0)", "date"])
def test_ids_of_any_type(spark, kind):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    as_id = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), c) if kind == "date" else F.col(c).cast(kind)
    df = spark.createDataFrame([(k, text(k)) for k in range(4)], "n int, text string")
    docs = df.select(as_id("n").alias("id"), "text", F.lit(1).alias("a-b"), F.lit(2).alias("score"))
    out = decontaminate.contaminated(docs, docs.where("`a-b` = 1"), "id", "text", "id", "text")
    assert out.columns[:2] == ["id", "item_id"] and out.where("id = item_id").count() == out.count() == 4
    assert decontaminate.clean(docs, docs, "id", "text", item_id="id").count() == 0


def test_rows_are_cleaned_by_their_own_text(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join("w" + str(i) for i in rng.integers(0, 5000, n))
    item = f"{text(20)}. {text(8)}."
    leak, plain = f"{text(50)} {item} {text(50)}", [text(100) for _ in range(3)]
    rows = [(None, leak), (None, plain[0]), (7, leak), (7, plain[1]), (8, plain[2])]
    df = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DDL)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.clean(df, bench)
    assert out.columns == df.columns
    assert got(out, "doc_id", "text") == Counter((i, t) for i, t in rows if t != leak)


def test_warc(spark):
    pages = [(1, "http://a.b/c", "x"), (2, "http://a.b/c", "x"), (3, None, None), (4, "u", ""), (None, "q", "x"), (5, "http://a.b/c", "x"), (5, "http://a.b/c", "x"), (6, "http://A.b:80/z\n d?é", "é\r\n\r\n" * 3000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        keep = largest[h or ""]
        want[i, len((h or "").encode()), digest(h), "response" if i == keep else "revisit", None if i == keep else keep] += 1
    assert got(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.round_trip(df.limit(0)).count() == 0
    assert got(warc.round_trip(df, min_bytes=1).where("page_id in (3, 4)"), "record_type") == Counter({("response",): 2})


def test_token_rollup(spark, sf_dir, tmp_path, docs, none):
    out = token_counts.corpus_rollup(docs)
    assert out.agg(F.sum("docs")).first()[0] == len({r.text or "" for r in docs.collect()})
    assert token_counts.corpus_rollup(none).count() == 0
    raw = token_counts.ranks("byte_bpe_50k")
    assert token_counts.encoding("byte_bpe_50k", raw).decode(token_counts.encoding("byte_bpe_50k", raw).encode_ordinary("naïve text")) == "naïve text"
    counted = lambda name, t: len(token_counts.encoding(name, token_counts.ranks(name)).encode_ordinary(t or ""))
    kept, want = set(), Counter()
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        if (r.text or "") not in kept:
            kept.add(r.text or "")
            name = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += counted(name, r.text)
    assert {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in out.collect()} == {k[:3]: (n, want[*k[:3], "tokens"]) for k, n in want.items() if k[3] == "docs"}
    ledger = token_counts.Rollup(spark, f"file://{tmp_path}/ledger")
    delta = spark.createDataFrame([("s", None, "t", 1, 5), ("s", None, "t", -1, -3), ("s", "en", "t", 1, 1)], "source string, lang string, tokenizer string, docs long, tokens long")
    assert ledger.commit("one", delta) and not ledger.commit("one", delta)
    totals = Counter({("s", None, 0, 2): 1, ("s", "en", 1, 1): 1})
    assert got(ledger.totals(), "source", "lang", "docs", "tokens") == totals
    # a driver that is lost after it has created the commit file: nothing counts, and the batch can be sent again
    (tmp_path / "ledger" / "commits" / b"two".hex()).touch()
    assert got(ledger.totals(), "source", "lang", "docs", "tokens") == totals
    assert ledger.commit("two", delta) and not ledger.commit("two", delta)
    assert got(ledger.totals(), "source", "lang", "docs", "tokens") == Counter({("s", None, 0, 4): 1, ("s", "en", 2, 2): 1})


def test_embeddings(spark):
    x = RNG.standard_normal((300, 16))
    x[200:240] = x[200] + 0.05 * RNG.standard_normal((40, 16))
    x[250] = x[251] * 3
    rows = [(int(i), [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, rows[5][1]), (304, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, x int")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in good if j != i and good[i] @ good[j] >= 0.95} if i in good else set() for i, _ in rows}
    low = {i: i for i, _ in rows}
    for _ in rows:
        for i, near in links.items():
            low[i] = min([low[i], *(low[j] for j in near)])
    out = got(neighbours.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    assert out == Counter((i, len(links[i]), low[i], low[i] == i) for i, _ in rows)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def linked(x, threshold=0.95):
    """(n_links, component_id) of each vector, by brute force."""
    x = np.asarray(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = (x @ x.T >= threshold) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in x:
        low = np.minimum(low, np.where(hit, low, len(x)).min(axis=1))
    return [(i, int(n), int(c), i == c) for i, (n, c) in enumerate(zip(hit.sum(axis=1), low, strict=True))]


def test_links_between_saturated_groups(spark):
    """Two groups that fill one another's lists of neighbours, and a few links across."""
    rng = np.random.default_rng(8)
    centres = np.zeros((2, 16))
    centres[0, 0], centres[1, :2] = 1, (math.cos(0.352), math.sin(0.352))
    x = np.concatenate([c + 0.012 * rng.standard_normal((40, 16)) for c in centres])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    across = (unit[:40] @ unit[40:].T >= 0.95).sum()
    assert 1 <= across <= 60 and (unit[:40] @ unit[:40].T).min() > 0.98
    x = np.concatenate([x, rng.standard_normal((50, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert got(neighbours.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == Counter(linked(x))


def test_audit_weighs_rows(spark):
    """A large group that is found doesn't hide isolated pairs that are not, nor do many rows without a link."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 16))
    x[:600] = x[0] + 0.02 * rng.standard_normal((600, 16))
    x[2000:2080] = x[2080:2160] * 1.5 + 0.001
    nodes = spark.createDataFrame([(i, bytearray(b"d" + r.tobytes()), 1) for i, r in enumerate(x)], "row_key long, x binary, times long")
    true = {i: n for i, n, _, _ in linked(x)}
    degrees = lambda ids: spark.createDataFrame([(i, true[i]) for i in ids], "row_key long, n long")
    assert neighbours.audit(nodes, degrees(range(600))) < 0.9
    assert neighbours.audit(nodes, degrees(range(3000))) == 1
    rare = nodes.where("row_key >= 600 and (row_key < 2001 or row_key > 2079)")
    assert neighbours.audit(rare, degrees([])) == 0


def test_all_are_compared_in_the_end(spark, monkeypatch):
    """Where the search finds nothing, with lists of any length, the result is right all the same."""
    monkeypatch.setattr(neighbours, "neighbour_graph", lambda nodes, *_: spark.createDataFrame([], "u long, v long, c double"))
    monkeypatch.setattr(neighbours, "CHUNK", 32)
    rng = np.random.default_rng(10)
    x = rng.standard_normal((120, 8))
    x[20:60] = x[20] + 0.1 * rng.standard_normal((40, 8))
    x[100:110] = x[:10] + 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert got(neighbours.near_duplicates(df), "vec_id", "n_links", "component_id", "kept") == Counter(linked(x))


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of a megabyte and a half, ties, repeated rows, and columns named like the operators' own."""
    rng = np.random.default_rng(21)
    long = " ".join(f"w{i}" for i in rng.integers(0, 100000, 220000))
    same = " ".join(f"w{i}" for i in rng.integers(0, 100000, 60))
    rows_ = [(0, long, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "fr", "b", 1), (2, same, "fr", "b", 1), (3, long[:1_000_000], "fr", "b", 1), (4, "", None, None, None), (5, None, None, None, None)]
    odd = ["at", "list", "family", "pair", "bucket", "item", "id_", "term", "n", "g", "h", "pos", "stop", "size", "x", "c", "digest", "a-b", "c d"]
    return spark.createDataFrame(rows_, DDL).select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])


def test_long_texts_ties_and_names(long_docs):
    """Each operator gives a row a document, and equal rows get equal results."""
    n = long_docs.count()
    twice = lambda df, *cols: [tuple(r[c] for c in cols) for r in df.where("doc_id = 2").collect()]
    out = suffix_dedup.remove_repeats(long_docs).cache()
    assert out.count() == n and {r.doc_id: r.n_removed for r in out.where("doc_id in (0, 1, 3)").collect()} == {0: 0, 1: 0, 3: 1_000_000} and [x[0] == x[1] for x in twice(out, "n_bytes", "n_removed")] == [True] * 2
    out = substring_dedup.remove_repeats(long_docs).cache()
    assert out.count() == n and out.columns[: len(long_docs.columns)] == long_docs.columns and {x[0] - x[1] for x in twice(out, "n_words", "n_removed")} == {0}
    out = simhash.near_duplicates(long_docs)
    assert out.count() == n and {x[0] for x in twice(out, "component_id")} == {1}
    out = near_copies.near_copies(long_docs)
    assert out.columns == [*long_docs.columns, "is_first"] and {r.doc_id for r in out.where("is_first").collect()} == {0, 1, 3, 4}
    scores = twice(lm_score.score(long_docs), "score")
    assert len(scores) == 2 and scores[0] == scores[1]
    out = langid.identify(long_docs)
    assert out.columns == [*long_docs.columns, "lang_pred", "score"] and len(set(twice(out, "lang_pred", "score"))) == 1 and out.count() == n
    out = mixing.mix(long_docs)
    assert out.count() == n and out.where("taken > 3 * size").count() == 0
    assert decontaminate.clean(long_docs, long_docs.where("doc_id = 1"), item_id="doc_id").count() == n - 3
    assert token_counts.corpus_rollup(long_docs).agg(F.sum("docs")).first()[0] == 4

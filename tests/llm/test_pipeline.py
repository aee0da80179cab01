"""The pipeline on the smallest tables, stage by stage."""

import math
from collections import Counter

import corpus_pipeline
from strata.llm import decontaminate
from strata.llm.common import materialize, table
from tests.llm.test_operators import first_of


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir))
        if name != "source_mix":
            assert out.columns == docs.columns
            assert dict(out.dtypes) == dict(docs.dtypes)
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[-1]


def test_stages_by_brute_force(spark, sf_dir):
    """What near-copy removal, substring removal and decontamination decide on the smallest tables, by comparing all with all."""
    docs = materialize(corpus_pipeline.language_id(spark, table(spark, sf_dir, "documents"), sf_dir))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    low, pairs = first_of([r.text for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()}
    want = {rows[i].doc_id for i in set(low)}
    gone = len(rows) - len(want)
    # what goes must go, and of what should go nine in ten must (candidates are found by fingerprints)
    assert want <= kept and gone and len(rows) - len(kept) >= 0.9 * gone
    words = {r.doc_id: r.text.encode().split() for r in rows}
    count = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    for r in corpus_pipeline.substring_removal(spark, docs, sf_dir).collect():
        w = words[r.doc_id]
        cut = {k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        assert r.text.encode().split() == [x for k, x in enumerate(w) if k not in cut]
    items = {r.item_id: decontaminate._of(r.text or "") for r in table(spark, sf_dir, "benchmark").collect()}
    texts = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    items = {i: w for i, w in items.items() if w}
    often, mean = Counter(t for w in items.values() for t in set(w)), sum(map(len, items.values())) / len(items)
    impact = {i: {t: math.log(1 + (len(items) - often[t] + 0.5) / (often[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in Counter(w).items()} for i, w in items.items()}
    parts = {i: decontaminate.question_and_answer(texts[i]) for i in items}
    wide, bad = max(128, 2 * max(map(len, items.values()))), set()
    for r in rows:
        w = decontaminate._of(r.text)
        for at in range(0, max(1, len(w) - wide // 2), wide // 2):
            passage = w[at : at + wide]
            terms = set(passage)
            for i, by in impact.items():
                if sum(v for t, v in by.items() if t in terms) >= 0.5 * sum(by.values()) and all(decontaminate.overlap(p, passage) >= 0.5 for p in parts[i]):
                    bad.add(r.doc_id)
    assert bad and {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()} == {r.doc_id for r in rows} - bad

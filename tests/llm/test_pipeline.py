"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ebbline.llm import queries
from ebbline.llm.shared import stored
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, odd_texts, rows_of

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = queries.read(spark, FOLDER, "documents")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.columns[:5] == COLUMNS
        found.append(docs.collect())
    return found


def test_quality_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.read(spark, folder, "labels").collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, queries.read(spark, folder, "documents"), folder).collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) > 0.9 * len(good)
    assert sum(i in kept for i in bad) < 0.2 * len(bad)


def test_exact_dedup_keeps_the_largest_id(steps):
    largest = defaultdict(int)
    for r in steps[1]:
        largest[r.text] = max(largest[r.text], r.doc_id)
    assert Counter(r.doc_id for r in steps[2]) == Counter(largest.values())


def test_near_dedup_keeps_one_of_each_component(steps):
    rows = [r.asDict() for r in steps[2]]
    found, _ = brute.near_components(rows, 80)
    want = [r["doc_id"] for r, (n, c) in zip(rows, found, strict=True) if n == 0 or r["doc_id"] == c]
    assert sorted(r.doc_id for r in steps[3]) == sorted(want)


def test_decontamination_cuts_the_passages(spark, steps):
    items = [(r.item_id, r.text) for r in queries.read(spark, FOLDER, "benchmark").collect()]
    after = {r.doc_id: r.text for r in steps[4]}
    for r in steps[3]:
        words, hit, _ = brute.contamination(r.text, items)
        if words and all(hit):
            assert r.doc_id not in after
        elif not any(hit):
            assert after[r.doc_id] == r.text
        else:
            assert brute.PLAIN.findall(brute.lower(after[r.doc_id])) == [w for w, h in zip(words, hit, strict=True) if not h]


def test_mix_meets_its_targets(steps):
    sizes, taken = Counter(), Counter()
    for r in steps[4]:
        sizes[r.source] += len(brute.WHITE.findall(r.text))
    for r in steps[5]:
        assert r.copies in (1, 2, 3)
        taken[r.source] += r.copies * len(brute.WHITE.findall(r.text))
    want = brute.targets(sizes)
    largest = max(len(brute.WHITE.findall(r.text)) for r in steps[4])
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in sizes)


def test_run_gives_the_last_stage(spark, steps):
    found = corpus_pipeline.run(spark, FOLDER)
    assert Counter((r.doc_id, r.copies) for r in found.collect()) == Counter((r.doc_id, r.copies) for r in steps[-1])


def test_stages_take_clashing_column_names(spark):
    """Extra columns of any name come through every stage with their values, repeated rows among them."""
    rows = rows_of(odd_texts()) * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = ["a.b", "b`c", "_text_hash", "text_hash", "quality_score", "id", "hash", "stays", "last", "epochs", "carry_id", "own_lang", "clean"]
    extra = [c for c in extra if c not in docs.columns]
    docs = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in extra))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert set(docs.columns) >= {*COLUMNS, *extra}
        for r in docs.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for c in extra)
    assert docs.count()


def test_stages_take_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(rows_of(odd_texts()) + rows_of([odd_texts()[6], None], [6, None]), SCHEMA)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            kept = stored(stage(spark, docs, FOLDER), name)
            assert set(docs.columns) <= set(kept.columns)
            assert kept.count() <= docs.count()

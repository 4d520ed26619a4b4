"""Best rows of many queries by one pass, against plain Python and the scores of all pairs."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm import decontaminate
from codicil.operators import applicability, best, neighbours, retrieval


def _sections(spark, rng, n=260):
    vocabulary = [f"word{i}" for i in range(30)] + ["nox", "sip"]
    day = lambda: None if rng.random() < 0.4 else date(2024, 1, 1) + timedelta(rng.randrange(300))
    rows = [(i, "s", i % 3, f"n{rng.randrange(40):02d}", rng.randrange(2), day(), day(), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12))), "ab"[i % 2]) for i in range(n)]
    rows += [(n + i, "s", 0, "same", 1, None, None, "word1 word2 word3", "a") for i in range(9)] + [(n + 10, "s", 0, "none", 1, None, None, None, "b")]
    return spark.createDataFrame(rows, "policy_id int, section_ref string, position int, name string, version int, effective_from date, effective_to date, body string, lang string").repartition(5)


def _asked(spark, rng, n=90):
    rows = [(i, " ".join(rng.choices([f"word{j}" for j in range(34)] + ["nitrogen oxides"], k=rng.randrange(1, 6))), date(2024, 1, 1) + timedelta(rng.randrange(300))) for i in range(n)]
    return spark.createDataFrame([*rows, (900, "", date(2024, 5, 5)), (901, None, date(2024, 5, 5)), (902, "word1 word2", None)], "query_id int, text string, as_of date")


@pytest.mark.parametrize("blocks", [{}, {"QUERIES": 40, "ASKED": 16, "ROWS": 32, "PAIRS": 8}, {"ASKED": 64, "DENSE": 1e9}, {"ROWS": 7, "DENSE": 0}])
@pytest.mark.parametrize("k", [1, 4])
def test_best_by_keywords_are_those_of_all_pairs(spark, monkeypatch, blocks, k):
    for name, value in blocks.items():
        monkeypatch.setattr(best, name, value)
    rng = random.Random(3)
    flat, asked = _sections(spark, rng), _asked(spark, rng)
    scores = retrieval.keyword_scores(asked, flat, carry=("lang",)).cache()
    columns = ["query_id", "rank", "name", "version", "position", "score"]  # rows with one name, version and position are in no order
    want = sorted(map(tuple, retrieval.top(scores, k).select(*columns).collect()))
    found = retrieval.keyword(asked, flat, k)
    assert sorted(map(tuple, found.select(*columns).collect())) == want and want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # no pairs are moved
    by = retrieval.best_by_keywords(asked, flat, k, carry=("lang",), by="lang")
    for lang in "ab":
        of = sorted(map(tuple, retrieval.top(scores.where(F.col("lang") == lang), k).select(*columns).collect()))
        assert sorted(map(tuple, retrieval.top(by.where(F.col("lang") == lang), k).select(*columns).collect())) == of
    full = retrieval.best_by_keywords(asked, flat, k, share=1.0).where("NOT listed")
    assert sorted((r.query_id, r.policy_id) for r in full.collect()) == sorted((r.query_id, r.policy_id) for r in scores.where("score = 1").collect())
    every = retrieval.best_by_keywords(asked, flat, k, share=0.0).where("NOT listed").drop("listed")
    assert sorted(map(tuple, every.select("query_id", "policy_id", "score").collect())) == sorted(map(tuple, scores.select("query_id", "policy_id", "score").collect()))


def test_sums_of_applicable_policies_without_their_pairs(spark, monkeypatch):
    rng, day0 = random.Random(6), date(2023, 5, 17)
    day = lambda: None if rng.random() < 0.2 else day0 + timedelta(rng.randrange(-40, 90))
    windows = [(i, rng.choice("xy") if i % 9 else None, day(), day()) for i in range(400)]
    cases = [(i, day0 + timedelta(rng.randrange(0, 50))) for i in range(150)] + [(500, None), (7, day0)]
    met, seen = [], applicability.applicable

    def counted(*given):
        out = seen(*given)
        met.append(out.count())
        return out

    monkeypatch.setattr(applicability, "applicable", counted)
    policies = spark.createDataFrame(windows, "policy_id long, source string, effective_from date, effective_to date")
    found = applicability.applicable_sums(spark.createDataFrame(cases, "case_id long, case_date date"), policies.union(policies), "source").collect()
    want = {}
    for c, d in cases:
        for p, s, a, b in windows:
            if d is not None and (a is None or a <= d) and (b is None or b > d):
                want.setdefault((c, s), []).append(p)
    assert {(r.case_id, r.source): (r.policies, r.first_policy, r.policy_sum) for r in found} == {k: (2 * len(v), min(v), 2 * sum(v)) for k, v in want.items()}
    assert met[0] <= 400 * 50 < 2 * sum(map(len, want.values()))  # twice the rows and thrice the cases make no more of what is joined


@pytest.mark.parametrize("blocks", [{}, {"QUERIES": 12, "ASKED": 5, "ROWS": 16, "PAIRS": 64}])
@pytest.mark.parametrize("positive", [False, True])
def test_best_by_vectors_are_those_of_all_pairs(spark, monkeypatch, blocks, positive):
    for name, value in blocks.items():
        monkeypatch.setattr(best, name, value)
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    data = [(i, "s", 0, f"n{i // 2:03d}", i % 2, rng.choice(some), None if i % 3 else date(2024, 3, 1), None if i % 4 else date(2024, 9, 1)) for i in range(400)]
    data += [(500, "s", 0, "a", 1, None, None, None), (501, "s", 0, "b", 1, [0.0] * 6, None, None), (502, "s", 0, "c", 1, [1.0, 2.0], None, None), (503, "s", 0, "d", 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None)]
    rows = spark.createDataFrame(data, "policy_id int, section_ref string, position int, name string, version int, embedding array<float>, effective_from date, effective_to date").repartition(4)
    asked = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 2 else some[i], date(2024, 1, 1) + timedelta(9 * i)) for i in range(40)]
    asked = spark.createDataFrame([*asked, (90, [0.0] * 6, date(2024, 4, 4)), (91, None, date(2024, 4, 4)), (92, [1.0, 1.0], date(2024, 4, 4))], "query_id int, query_embedding array<double>, as_of date")
    columns = ["query_id", "rank", "name", "version", "score"]
    scores = retrieval.vector_scores(asked, rows, positive)
    held = scores.where("(effective_from IS NULL OR effective_from <= as_of) AND (effective_to IS NULL OR effective_to > as_of)")
    found = retrieval.best_by_vectors(asked, rows, 7, positive)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, retrieval.top(held, 7).select(*columns).collect()))
    plain = retrieval.best_by_vectors(asked.drop("as_of"), rows, 7, positive)
    assert sorted(map(tuple, plain.select(*columns).collect())) == sorted(map(tuple, retrieval.top(scores, 7).select(*columns).collect()))


def test_index_finds_the_first_of_many_copies(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(30, 16))
    order = rng.permutation(30 * 400)
    df = spark.createDataFrame([(int(i), points[i % 30].tolist()) for i in order], "id long, embedding array<double>").repartition(6)
    index = neighbours.VectorIndex.build(df)
    assert index.rows.count() == 30
    asked = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = index.search(asked, df, 10).collect()
    assert len(found) == 120 * 10 and all(r.id == r.query_id % 30 + 30 * (r["rank"] - 1) and r.score == 1 for r in found)


def test_index_fills_lists_whose_cells_are_closed(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([c + rng.normal(size=(40, 8)) * 0.1 for c in np.eye(8) * 9])
    df = spark.createDataFrame([(i, p.tolist(), None, date(2024, 1, 1) if i < 40 else None) for i, p in enumerate(points)], "id long, embedding array<double>, effective_from date, effective_to date")
    index = neighbours.VectorIndex.build(df)
    asked = df.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.lit(date(2024, 6, 1)).alias("as_of"))
    assert [r.n for r in index.search(asked, df, 10, probed=1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()] == [10] * 5


def test_benchmark_basis_is_fitted_without_a_sample_of_documents(spark, monkeypatch):
    fitted, fit = [], decontaminate.fit_basis

    def seen(texts, *given):
        fitted.extend(r.text for r in texts.collect())
        return fit(texts, *given)

    monkeypatch.setattr(decontaminate, "fit_basis", seen)
    item = "the quick brown fox jumps over a lazy dog near seven silent rivers"
    docs = spark.createDataFrame([(i, f"plain words of text number {i} " * 9) for i in range(40)] + [(90, f"before it {item} and after it")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).where("contaminated").collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(90, 5)]
    assert fitted == [item]


@pytest.mark.parametrize("blocks", [{}, {"SINGLE": 40, "RICH": 3, "RARE": 1, "PAIRS": 16}, {"RICH": 0, "RARE": 9}])
def test_the_best_row_alone_is_found_by_rarest_words(spark, monkeypatch, blocks):
    for name, value in {"ASKED": 1, **blocks}.items():
        monkeypatch.setattr(best, name, value)
    seen, first = [], best.first_by_keywords
    monkeypatch.setattr(best, "first_by_keywords", lambda *a: seen.append(first(*a)) or seen[-1])
    rng = random.Random(5)
    rows, asked = _sections(spark, rng), _asked(spark, rng)
    plain = lambda df: {tuple(r) for r in df.drop("policy_id").collect()}  # noqa: E731  # names repeat, so that ties of all else are open
    assert plain(retrieval.keyword(asked, rows, 1)) == plain(retrieval.top(retrieval.keyword_scores(asked, rows), 1))
    assert len(seen) == 1  # many queries take this way

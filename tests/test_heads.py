"""Heads against finite differences, the two-class case, and a training that knows no partitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.functions import text
from codicil.operators import heads, priors

ROWS = "doc long, places array<int>, values array<double>, y array<int>"


@pytest.mark.parametrize("kind", heads.KINDS)
def test_two_classes_are_separated(spark, tmp_path, kind):
    rows = spark.createDataFrame([(0, [0], [1.0], [1, 0]), (1, [0], [1.0], [1, 0]), (2, [1], [1.0], [0, 1]), (3, [1], [1.0], [0, 1])], ROWS)
    head = heads.fit(rows, 2, ["a", "b"], kind, epochs=40, hidden=8, rate=0.05)
    assert head.losses[-1] < head.losses[0] / 2
    got = {(r.doc, r.label): r.score for r in heads.scores(head, rows.where("doc in (0, 2)"), 2).collect()}
    assert got[0, "a"] > got[0, "b"] and got[2, "b"] > got[2, "a"]
    head.save(f"file://{tmp_path}", "models/head.npz")
    again = heads.Head.load((tmp_path / "models/head.npz").read_bytes())
    assert (again.kind, again.names) == (kind, ["a", "b"]) and all((p == q).all() for p, q in zip(again.parts, head.parts, strict=True))


@pytest.mark.parametrize("kind", heads.KINDS)
def test_gradients_are_those_of_the_loss(kind):
    rng = np.random.default_rng(1)
    x, y, positive = rng.normal(size=(5, 4)), rng.integers(0, 2, (5, 3)).astype(float), np.array([1.0, 3.0, 20.0])
    head = heads.Head.begin(kind, 4, ["a", "b", "c"], 6, 2)
    mask = heads._mask(np.arange(5), 6, 1) if kind == "mlp" else None
    own, _ = head.gradient(x, y, positive, mask)
    for part, g in zip(head.parts, own, strict=True):
        for at in np.ndindex(part.shape):
            kept, ends = part[at], []
            for step in (1e-6, -1e-6):
                part[at] = kept + step
                ends.append(head.gradient(x, y, positive, mask)[1])
            part[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-6 - g[at]) < 1e-4


def test_partitions_change_nothing(spark):
    rng = np.random.default_rng(3)
    data = [(i, [int(j) for j in sorted(rng.choice(10, 3, replace=False))], [float(v) for v in rng.random(3)], [int(i % 2), int(i % 5 == 0)]) for i in range(60)]
    rows = spark.createDataFrame(data, ROWS)
    a, b = (heads.fit(r, 10, ["x", "y"], "mlp", epochs=4, hidden=5) for r in (rows.coalesce(1), rows.repartition(6)))
    assert all(np.allclose(p, q, atol=1e-10) for p, q in zip(a.parts, b.parts, strict=True)) and np.allclose(a.losses, b.losses)
    assert 0.05 < 1 - (heads._mask(np.arange(400), 50, 3) > 0).mean() < 0.15


def test_rows_of_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta", ["p"]), (2, "gamma", ["q", "p"]), (3, "", [])], "doc long, text string, labels array<string>")
    terms = spark.createDataFrame([("alpha", 1), ("beta", 1)], "token string, df long")
    rows = {r.doc: r for r in heads.rows_for(priors.tfidf(docs, terms, F.lit(3)), terms, docs, ["p", "q"]).collect()}
    assert rows[1].places == [0, 1] and abs(sum(v * v for v in rows[1]["values"]) - 1) < 1e-12
    assert (rows[2].places, rows[2].y, rows[3].y) == ([], [1, 1], [0, 0])
    empty = spark.createDataFrame([], ROWS)
    head = heads.fit(empty, 2, ["p"], "linear")
    assert heads.scores(head, empty, 2).count() == 0
    with pytest.raises(ValueError, match="tree"):
        heads.Head.begin("tree", 1, [], 1, 1)


def test_words_of_texts_once(spark):
    data = [(1, "p", "Alpha beta beta NOx"), (2, "q", "gamma  nitrogen\noxides, alpha alpha"), (3, "p", "nitrogen and oxides ab"), (4, "q", None), (5, "p", ""), (6, "q", "pm2.5 alpha gamma new source"), (7, "p", "K\u212aLM \u0130stanbul stra\u00dfe\u00e9tude \u4e2d\u6587abc a\x1fb\u2028nox")]
    docs = spark.createDataFrame(data, "doc long, label string, text string")
    words = priors.word_counts(docs, ["doc", "label"])
    got = {r.doc: r for r in words.collect()}
    assert dict(zip(got[1].t, got[1].n, strict=True)) == {"alpha": 1, "beta": 2, "nox": 1} and got[4].t == got[5].t == []
    want = docs.select("doc", text.expanded_tokens(F.col("text")).alias("e")).collect()
    assert all(set(r.e or []) == {*got[r.doc].t, *(got[r.doc].more or [])} for r in want)
    assert {"nitrogenoxides", "oxides"} <= set(got[1].more) and got[3].more in (None, [])
    terms = spark.createDataFrame([("alpha", 3), ("beta", 1), ("gamma", 2)], "token string, df long")
    labelled = docs.withColumn("labels", F.array("label"))
    plain = {r.doc: r for r in heads.rows_for(priors.tfidf(docs, terms, F.lit(7)), terms, labelled, ["p", "q"]).collect()}
    rows = heads.rows_of_words(words.withColumn("labels", F.array("label")), terms, 7, ["p", "q"])
    for r in rows.collect():
        assert (r.places, r.y) == (plain[r.doc].places, plain[r.doc].y) and np.allclose(r["values"], plain[r.doc]["values"], atol=1e-12)
    both = heads.fit_kinds(rows, 3, ["p", "q"], epochs=3, hidden=4)
    for kind in heads.KINDS:
        one = heads.fit(rows, 3, ["p", "q"], kind, epochs=3, hidden=4)
        assert np.allclose(one.losses, both[kind].losses) and all(np.allclose(p, q) for p, q in zip(one.parts, both[kind].parts, strict=True))

"""Golden values of functions and operators."""

from __future__ import annotations

import http.server
import io
import json
import random
import re
import threading
import urllib.error
import urllib.parse
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codicil.functions import labels, privacy, stems, text as texts
from codicil.functions.vectors import cosine
from codicil.operators import drift, evaluate, fulltext, ingest, priors, retrieval, review, validate, workflow
from codicil.sources import pages, regulations


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_keyword_score_and_order(spark):
    q = spark.createDataFrame([(1, "Reports must be submitted within 30 days after notice.", date(2026, 6, 1))], "query_id long, text string, as_of date")
    rows = [(1, "a", 1, "zeta", "Reports must be submitted within 30 days after notice."), (2, "b", 1, "alpha", "Reports follow notice."), (3, "c", 2, "alpha", "Reports follow notice.")]
    flat = spark.createDataFrame(rows, "policy_id long, section_ref string, version int, name string, body string").withColumns({"position": F.lit(0), "effective_from": F.lit(None).cast("date"), "effective_to": F.lit(None).cast("date")})
    got = [(r.name, r.version, round(r.score, 6)) for r in retrieval.keyword(q, flat).orderBy("rank").collect()]
    assert got == [("zeta", 1, 1.0), ("alpha", 2, round(2 / 7, 6)), ("alpha", 1, round(2 / 7, 6))]


def test_effective_window(spark):
    from codicil.operators.catalog import in_force

    rows = [(1, None, date(2026, 6, 1)), (2, date(2026, 6, 1), None), (3, date(2026, 6, 2), None), (4, None, None)]
    df = spark.createDataFrame(rows, "id int, effective_from date, effective_to date")
    assert [r.id for r in df.where(in_force(F.lit("2026-06-01").cast("date"))).orderBy("id").collect()] == [2, 4]


@pytest.mark.parametrize(("query", "expected"), [("NOx", 'nox OR "nitrogen oxides"'), ("pm2.5 at the stack", 'pm2.5 at the stack OR "fine particulate matter"')])
def test_websearch_text(spark, query, expected):
    assert one(spark, x=texts.websearch_text(F.lit(query))).x == expected


def searchable(spark, bodies):
    rows = [(i, "s", 0, f"n{i:03d}", 1, None, None, t) for i, t in enumerate(bodies)]
    return spark.createDataFrame(rows, "policy_id int, section_ref string, position int, name string, version int, effective_from date, effective_to date, body string")


def searches(spark, asked):
    return spark.createDataFrame([(i, t, date(2026, 1, 1)) for i, t in enumerate(asked)], "query_id int, text string, as_of date")


def test_full_text_parser(spark):
    rows = fulltext.parsed(searches(spark, ['a "b c" OR -d e', "-x", '"p q', "or pm2.5 or"])).collect()
    got = sorted((r.query_id, r.clause, r.unit, r.negated, r.n, r.shift, r.lexeme) for r in rows)
    assert got == [(0, 0, 0, False, 1, 0, "a"), (0, 0, 1, False, 2, 0, "b"), (0, 0, 1, False, 2, 1, "c"), (0, 1, 3, True, 1, 0, "d"), (0, 1, 4, False, 1, 0, "e"), (2, 0, 0, False, 1, 0, "p"), (2, 0, 1, False, 1, 0, "q"), (3, 1, 1, False, 2, 0, "pm2"), (3, 1, 1, False, 2, 1, "5")]


def brute_covers(search, body):
    """Score by trying every stretch of the body's words."""
    words = re.findall("[a-z0-9]+", body.lower())
    clauses = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', search.lower()):
        if m[3] == "or":
            clauses.append([])
        elif unit := re.findall("[a-z0-9]+", m[2] if m[3] is None else m[3]):
            clauses[-1].append((bool(m[1]) if m[3] is None else m[3].startswith("-"), unit))
    clauses = [c for c in clauses if any(not n for n, _ in c)]
    named = {w for c in clauses for _, u in c for w in u}
    held = lambda unit, part: any(part[i : i + len(unit)] == unit for i in range(len(part)))
    good = [c for c in clauses if all(held(u, words) != n for n, u in c)]
    stretches = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if any(all(held(u, words[i : j + 1]) for n, u in c if not n) for c in good)]
    shortest = [(i, j) for i, j in stretches if not any((i, j) != (a, b) and i <= a and b <= j for a, b in stretches)]
    return round(sum(0.1 / (1 + sum(w not in named for w in words[i : j + 1])) for i, j in shortest), 9)


def test_covers_are_those_of_all_stretches(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "AT_ONCE", 30)  # so that bounds decide
    rng = random.Random(4)
    bodies = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 26))) for _ in range(150)] + ["", "z" * 50]
    asked = ["a", "a b", '"a b"', '"a b" c -d', "a b c OR d e", '"c d e" OR "e d c" OR g -"a b"', "a -b OR b -a", "q OR a", "q", "-a", "a a", '"a a"', "a OR b OR c OR d"]
    flat, q = searchable(spark, bodies), searches(spark, asked)
    got = {(r.query_id, r.policy_id): r.score for r in fulltext.fulltext_scores(q, flat).collect()}
    want = {(i, k): s for i, t in enumerate(asked) for k, b in enumerate(bodies) if (s := brute_covers(t, b))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    for k in (1, 5, 40):  # bounds leave out nothing that is among the best
        kept = {(r.query_id, r.policy_id): r.score for r in fulltext.fulltext_scores(q, flat, best=k).collect()}
        for i in range(len(asked)):
            own = sorted((s for (j, _), s in want.items() if j == i), reverse=True)
            least = own[min(k, len(own)) - 1] if own else 0
            assert {p for (j, p), s in want.items() if j == i and s > least + 1e-8} <= {p for j, p in kept if j == i}
            assert sum(j == i for j, _ in kept) >= min(k, len(own))


def test_all_alternatives_add_up(spark):
    body = " ".join(["nox and more"] * 10 + ["nitrogen oxides or less"] * 8)
    q = searches(spark, ["NOx"]).withColumn("text", texts.websearch_text(F.col("text")))
    index = fulltext.PostingIndex.build(searchable(spark, [body, "nitrogen and oxides", "oxides nitrogen nox"]))
    for _ in range(2):  # one index serves many batches
        assert {r.policy_id: r.score for r in fulltext.fulltext_scores(q, None, index=index).collect()} == {0: 1.8, 2: 0.1}


def test_prior_inside_full_text(spark):
    flat, q = searchable(spark, ["nox rule", "nox rule", "rule"]), searches(spark, ["nox"])
    prior = spark.createDataFrame([(0, "40:60", 1.0), (0, "40:52", 0.5)], "query_id int, label string, probability double")
    labels_of = spark.createDataFrame([(1, ["40:52", "40:60"]), (2, ["40:60"])], "policy_id int, labels array<string>")
    rows = retrieval.two_phase(fulltext.fulltext_scores(q, flat, best=100), prior, labels_of, 5).orderBy("rank").collect()
    assert [(r.policy_id, r.score) for r in rows] == [(1, 0.15), (0, 0.1)]


def test_english_stems():
    known = {
        "regulations": "regul", "implementation": "implement", "states": "state", "emissions": "emiss", "pollutants": "pollut", "quality": "qualiti",
        "sources": "sourc", "monitoring": "monitor", "agencies": "agenc", "reporting": "report", "hopping": "hop", "hoping": "hope", "national": "nation",
        "consistently": "consist", "conditional": "condit", "generally": "general", "skies": "sky", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this",
        "organization": "organ", "effectiveness": "effect", "plastered": "plaster", "agreed": "agre", "feed": "feed", "controlling": "control", "rate": "rate",
        "probate": "probat", "cease": "ceas", "knightly": "knight", "happy": "happi", "say": "say", "by": "by", "exceed": "exceed", "communism": "communism",
    }
    assert {w: stems.stem(w) for w in known} == known


def test_english_full_text(spark):
    flat = searchable(spark, ["", "The agency regulates emissions of stationary sources.", "An emission source was regulated by agencies in the state.", "State plans for ozone."])
    asked = ["regulating sources", "stationary sources", '"emission of stationary source"', "the state -ozone", "the of", "plan OR stationary"]
    q = searches(spark, asked)
    found = {}
    for r in fulltext.fulltext_scores(q, flat, stemmed=True).collect():
        found.setdefault(r.query_id, set()).add(r.policy_id)
    assert found == {0: {1, 2}, 1: {1}, 2: {1}, 3: {2}, 5: {1, 3}}
    words = fulltext.all_words(q.where("query_id < 2"), flat, stemmed=True).collect()
    assert {(r.query_id, r.policy_id) for r in words} == {(0, 1), (0, 2), (1, 1)}


def test_cosine(spark):
    vec = lambda *v: F.array(*map(F.lit, v))
    r = one(spark, same=cosine(vec(1.0, 0.0), vec(2.0, 0.0)), zero=cosine(vec(0.0, 0.0), vec(1.0, 0.0)), uneven=cosine(vec(1.0), vec(1.0, 0.0)))
    assert (r.same, r.zero, r.uneven) == (1.0, 0.0, 0.0)


def test_redaction():
    text = "Mail a.b@example.org, call (555) 123-4567, number 123-45-6789, and 4111 1111 1111 1111."
    assert privacy.redact(text) == ("Mail [e], call [p], number [s], and [c].", 4)
    assert privacy.redact("1234567890123456") == ("1234567890123456", 0)


def test_claims_and_quotes(spark):
    assert privacy.claims_of("Report within 15 days, or on 2027-01-01.") == ["within 15 days", "on 2027-01-01"]
    content = F.lit("Customer records   must be retained for years.")
    verdict = lambda q: one(spark, x=validate.quote_verdict(content, F.lit(q))).x
    assert verdict("Customer") == "citation_quote_too_short"
    assert verdict("ustomer records must be retained") == "citation_quote_not_found"
    assert verdict("Customer records must\nbe retained") is None


def test_validation_order(spark):
    outputs = spark.createDataFrame([(1, "Do so within 30 days.", 0.5)], "case_id int, rationale string, confidence double")
    citations = spark.createDataFrame([(1, 0, 9, "9", "a quotation of sufficient length")], "case_id int, ord int, source int, ref string, quote string")
    sources = spark.createDataFrame([(1, 1, "text")], "case_id int, source int, content string")
    got = validate.errors(outputs, citations, sources, ["source"], threshold=0.7).first().errors
    assert got == ["confidence_below_review_threshold", "citation_not_retrieved:9", "rationale_temporal_claim_not_cited:within 30 days"]


def test_chunks(spark):
    paragraphs = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcd"]
    df = spark.createDataFrame([(1, 0, "§ 60.5", None, paragraphs), (1, 1, "short", None, ["too few words"])], "doc int, ord int, section_ref string, heading string, paragraphs array<string>")
    got = ingest.chunks(df).orderBy("position").collect()
    assert [(r.section_ref, r.position) for r in got] == [("§ 60.5", 0), ("§ 60.5#2", 1)]
    assert got[1].text.startswith(" ".join(paragraphs[2].split()[-50:]))


def test_versions(spark):
    schema = "document_number string, version int, content_hash string, status string"
    current = spark.createDataFrame([("a", 1, "x", "ACTIVE"), ("b", 1, "y", "ACTIVE")], schema)
    incoming = spark.createDataFrame([("a", "z", "ACTIVE"), ("b", "y", "ACTIVE"), ("c", "w", "DRAFT")], "document_number string, content_hash string, status string")
    got = sorted(tuple(r) for r in ingest.versioned_load(current, incoming).select("document_number", "version", "status").collect())
    assert got == [("a", 1, "RETIRED"), ("a", 2, "ACTIVE"), ("b", 1, "ACTIVE"), ("c", 1, "DRAFT")]


def test_gate_blocks_duplicates(spark):
    rows = [("1", "t", "RULE", date(2026, 1, 1), None, 1, 0)] * 2
    df = spark.createDataFrame(rows, "document_number string, title string, document_type string, publication_date date, parse_error string, n_chunks int, n_residual int")
    assert ingest.gate(df).first().reasons == "duplicate_document_numbers"
    assert ingest.passed(df).count() == 0 and ingest.passed(df.limit(1)).count() == 1


def test_metrics(spark):
    judged = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True)], "query_id int, rank int, hit boolean")
    r = evaluate.query_metrics(judged, spark.createDataFrame([(1, 1)], "query_id int, n int"), (2, 3)).first()
    assert (r.recall_2, r.recall_3, r.mrr, r.ndcg) == (0.0, 1.0, pytest.approx(1 / 3), pytest.approx(0.5))
    p = evaluate.percentiles(spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 9.0)], "k string, v double"), "k", "v").first()
    assert p.p95 == pytest.approx(8.6)


def test_percentiles_of_large_tied_and_null_groups(spark):
    rows = spark.range(4000).selectExpr("case id % 4 when 0 then null when 1 then 'many' else 'tied' end as k", "case when id % 4 = 2 then 7.0D when id % 5 = 0 then null else cast(pmod(hash(id), 10007) as double) end as v")
    rows = rows.union(spark.createDataFrame([("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None)], rows.schema))
    want = rows.groupBy("k").agg(F.percentile("v", 0.5), F.percentile("v", 0.95)).collect()
    got = {r.k: (r.p50, r.p95) for r in evaluate.percentiles(rows, "k", "v").collect()}
    assert got == {k: (None if low is None else pytest.approx(low), None if high is None else pytest.approx(high)) for k, low, high in want}
    assert evaluate.percentiles(rows.limit(0), "k", "v").count() == 0


def test_stability_and_shift(spark):
    mix = lambda a, b: spark.createDataFrame([("x",)] * a + [("y",)] * b, "k string")
    assert drift.population_stability(mix(90, 10), mix(10, 90), "k").first().drifted
    assert drift.population_stability(mix(5, 5), mix(10, 10), "k").first().psi == 0
    vectors = [[0.0, 0.0], [2.0, 0.0], [0.0, 1.0], [2.0, 1.0]]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "v array<double>")
    shift, explained = drift.principal_shift(frame(vectors), frame([[a - 1, b + 1] for a, b in vectors]), "v", 2)
    assert shift == pytest.approx(2**0.5) and explained == pytest.approx([0.8, 0.2])


def test_prior_prefers_its_label(spark):
    e = spark.createDataFrame([(1, "40:60", "stationary sources emission"), (2, "40:52", "implementation plans approval")], "doc int, label string, text string")
    q = spark.createDataFrame([(1, "emission of stationary sources")], "query_id int, text string")
    p = {r.label: r.probability for r in priors.predict_prior(q, *priors.fit_prior(e)).collect()}
    assert p["40:60"] > p["40:52"] and sum(p.values()) == pytest.approx(1)


def test_fencing(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, 0, t, "queued"), (1, 1, t, "claimed"), (1, 2, t + timedelta(seconds=90), "finalised"), (1, 3, t + timedelta(seconds=100), "claimed"), (1, 4, t + timedelta(seconds=110), "finalised")]
    r = workflow.current_state(spark.createDataFrame(rows, "record long, seq long, ts timestamp, kind string")).first()
    assert (r.state, r.token, r.stale) == ("finalised", 2, 1)
    outbox = spark.createDataFrame([(0, t), (2, t)], "attempts int, available_at timestamp").withColumn("status", F.lit("DELIVERING"))
    after = workflow.after_delivery(outbox, F.lit(False), F.lit(t)).orderBy("attempts").collect()
    assert [(r.status, r.attempts, r.available_at) for r in after] == [("PENDING", 1, t + timedelta(seconds=2)), ("DEAD", 3, t)]


def test_renewal_moves_the_lease(spark):
    """A renewed lease outlives the claim's; one renewed too late is lost, and so is all that follows."""
    t = datetime(2026, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    kinds = [(1, "claimed", 0), (1, "renewed", 50), (1, "renewed", 100), (1, "finalised", 150), (1, "renewed", 155)]
    kinds += [(2, "claimed", 0), (2, "renewed", 61), (2, "finalised", 70), (3, "claimed", 0), (3, "failed", 10), (3, "finalised", 20)]
    log = spark.createDataFrame([(r, i, at(s), k) for i, (r, k, s) in enumerate(kinds)], "record long, seq long, ts timestamp, kind string")
    got = {r.record: (r.state, r.token, r.stale) for r in workflow.current_state(log).collect()}
    assert got == {1: ("finalised", 1, 1), 2: ("claimed", 1, 2), 3: ("failed", 1, 1)}
    ends = {(r.record, r.kind): r.lease_end for r in workflow.fenced(log).where("valid").collect()}
    assert ends[1, "renewed"] == at(160) and ends[2, "claimed"] == at(60)
    other = workflow.fenced(log.withColumn("acts_for", F.lit(7))).where("kind <> 'claimed' and valid")
    assert other.count() == 0


def test_renewals_and_releases(spark):
    """Golden values: the holder's live lease is renewed with its token kept; used-up attempts fail, others are queued."""
    t = datetime(2026, 1, 1)
    rows = [("a", "ANALYZING", "w1", 3, 1, t + timedelta(seconds=5)), ("b", "ANALYZING", "w1", 3, 3, t - timedelta(seconds=5)), ("c", "QUEUED", None, 0, 0, None)]
    cases = spark.createDataFrame(rows, "case_id string, status string, worker_id string, token int, attempts int, lease_end timestamp")
    asked = spark.createDataFrame([(c, w, 3) for c, w in (("a", "w1"), ("b", "w1"), ("c", "w1"))], "case_id string, worker_id string, token int")
    got = {r.case_id: (r.renewed, r.lease_end, r.token) for r in review.renewed(cases, asked, F.lit(t)).collect()}
    assert got == {"a": (True, t + timedelta(seconds=60), 3), "b": (False, t - timedelta(seconds=5), 3), "c": (False, None, 0)}
    got = {r.case_id: (r.status, r.event, r.error_code, r.worker_id, r.lease_end) for r in review.released(cases, asked).collect()}
    assert got == {"a": ("QUEUED", "analysis_requeued", None, None, None), "b": ("FAILED", "analysis_abandoned", "analysis_worker_error", "w1", None), "c": ("QUEUED", None, None, None, None)}
    late = asked.withColumn("token", F.lit(2))
    assert review.renewed(cases, late, F.lit(t)).where("renewed").count() == 0 and review.released(cases, late).where("event is not null").count() == 0


def test_labels_of_references(spark):
    cases = {
        '[{"title": 40, "part": "60"}, {"title": "40", "part": 52}, {"title": 40, "part": " 60 "}]': ["40:60", "40:52"],
        '[{"title": true, "part": "1"}, {"title": 40, "part": false}, {"title": 40, "part": " "}, {"title": 40}, 5, "x", null]': [],
        '{"title": 40, "part": "1"}': [],
        "not json": [],
        None: [],
    }
    df = spark.createDataFrame([(i, js) for i, js in enumerate(cases)], "i int, js string")
    got = [r.l for r in df.select("i", labels.part_labels(F.col("js")).alias("l")).orderBy("i").collect()]
    assert got == list(cases.values())
    first = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    r = spark.range(1).select(labels.preferred_label(first(["7:1", "40:2"])).alias("a"), labels.preferred_label(first(["7:1"])).alias("b"), labels.preferred_label(first([])).alias("c")).first()
    assert tuple(r) == ("40:2", "7:1", "other")
    with pytest.raises(Exception, match="384 numbers"):
        spark.range(1).select(labels.of_width(F.array(F.lit(1.0)), 384)).collect()


def test_modes_and_bounds(spark):
    assert [retrieval.mode_or_default(None, v) for v in (True, False)] == ["hybrid", "keyword"] and retrieval.mode_or_default("vector", False) == "vector"
    with pytest.raises(ValueError, match="nearest"):
        retrieval.mode_or_default("nearest", True)
    q = spark.createDataFrame([("a",)], "text string")
    retrieval.checked(q, 20)
    for rows, limit in ((q, 0), (q, 21), (q.select(F.repeat("text", F.lit(4001)).alias("text")), 5)):
        with pytest.raises(ValueError):
            retrieval.checked(rows, limit)


def test_outputs_and_outcomes(spark):
    good = '{"outcome": "COMPLIANT", "confidence": 0.9, "rationale": "r", "citations": []}'
    rows = [f"```json\n{good}\n```", good, good.replace("0.9", "1.9"), "no json"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", validate.parsed_output(F.col("x")).alias("v")).orderBy("i").collect()
    assert [r.v and r.v.outcome for r in got] == ["COMPLIANT", "COMPLIANT", None, None]
    none, some = F.array().cast("array<string>"), F.array(F.lit("citation_quote_not_found:1"), F.lit("citation_quote_not_found:2"), F.lit("other"))
    r = spark.range(1).select(
        validate.outcome(some, F.lit(True), F.lit(False), F.array(F.lit("override"))).alias("a"),
        validate.outcome(none, F.lit(False), F.lit(False), none).alias("b"),
        validate.retried(some, ["citation_quote_not_found"]).alias("c"),
        ingest.status_for(F.lit(" Final  Rule ")).alias("d"),
        ingest.status_for(F.lit("Notice")).alias("e"),
        evaluate.number_matches(F.lit("52.1#2"), ["52.1"]).alias("f"),
        evaluate.number_matches(F.lit("52.15"), ["52.1"]).alias("g"),
        evaluate.relevant(F.lit("s"), F.lit("d"), none, F.array(F.lit("d"))).alias("h"),
        evaluate.relevant(F.lit("s"), F.lit("d"), F.array(F.lit("t")), F.array(F.lit("d"))).alias("i"),
    ).first()
    assert (r.a.error_code, r.a.findings[-1], r.b.error_code, r.c) == (None, "injection_signal:override", "no_relevant_source", ["citation_quote_not_found"])
    assert (r.d, r.e, r.f, r.g, r.h, r.i) == ("ACTIVE", "DRAFT", True, False, True, False)


def test_search_address():
    url = pages.query_url("https://x/documents.json", date(2024, 1, 1), date(2024, 2, 1), 5000, agency="an-agency", type="RULE", cfr="40")
    asked = urllib.parse.parse_qsl(urllib.parse.urlsplit(url).query)
    assert asked[:7] == [("conditions[agencies][]", "an-agency"), ("conditions[type][]", "RULE"), ("conditions[cfr][title]", "40"), ("conditions[publication_date][gte]", "2024-01-01"), ("conditions[publication_date][lte]", "2024-02-01"), ("per_page", "1000"), ("order", "oldest")]
    assert [v for k, v in asked if k == "fields[]"] == list(pages.FIELDS)


def test_pages_as_a_source(spark):
    """Spark reads windows of a local service, page by page."""

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            rows = [{"document_number": f"n{i}", "title": " ", "cfr_references": [{"title": 40, "part": "60"}], "docket_ids": ["x", ""]} for i in range(3)]
            more = None if "page" in asked else f"http://127.0.0.1:{self.server.server_port}/documents.json?page=2"
            body = json.dumps({"count": 3, "results": rows[2:] if "page" in asked else rows[:2], "next_page_url": more}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(pages.PagedSource)
    read = spark.read.format("regulation_pages").options(url=f"http://127.0.0.1:{server.server_port}/documents.json", since="2024-01-01", until="2024-01-02")
    rows = sorted(read.load().collect())
    server.shutdown()
    assert [(r.document_number, r.title, r.cfr_references[0].part, r.docket_ids) for r in rows] == [(f"n{i}", None, "60", ["x"]) for i in range(3)]


def test_plain_text_sections():
    text = "Opening words.\n\nI. Background\n\nFirst.\n\nSecond.\n\nII. Action\n\n"
    assert regulations.plain_sections(text) == [("document", None, ["Opening words."]), ("preamble:I", "I. Background", ["First.", "Second."])]


def test_signature():
    assert workflow.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert len(workflow.signature("{}", "k")) == 64


XML = b"""<RULE><PREAMB><ACT><HD SOURCE="HED">ACTION:</HD><P>Final rule.</P></ACT><SUM><HD SOURCE="HED">S</HD><P>We act.</P></SUM></PREAMB>
<SUPLINF><HD SOURCE="HD1">I. Background</HD><P>NO<E T="52">X</E> limits apply.</P></SUPLINF>
<SECTION><SECTNO>&#167; 52.1570</SECTNO><SUBJECT>Scope.</SUBJECT><P>First ,  text.</P></SECTION></RULE>"""


def test_regulatory_xml(spark):
    sections, action = regulations.parse_body(XML)
    assert action == "Final rule."
    assert regulations.parse_body(b"<?xml version=\"1.0\"?><!DOCTYPE RULE>" + XML)[1] == "Final rule."
    with pytest.raises(ValueError, match="entities"):
        regulations.parse_body(b'<?xml version="1.0"?><!DOCTYPE RULE [<!ENTITY a "b">]><RULE/>')
    assert [(s[0], s[2]) for s in sections] == [("preamble:summary", ["We act."]), ("preamble:I", ["NOx limits apply."]), ("§ 52.1570", ["First, text."])]
    with pytest.raises(ValueError, match="access page"):
        regulations.parse_body(b"<html></html>")
    df = spark.createDataFrame([(bytearray(XML), None), (bytearray(b"<RULE>"), None), (None, None)], "payload binary, number string")
    got = df.select(regulations.parsed_body("payload", "number").alias("r")).select("r.*").collect()
    assert [len(r.sections) for r in got] == [3, 0, 0] and got[1].parse_error


def test_markup_text():
    assert texts.clean_markup("PM<sub>2.5</sub> and regula-\n tions") == "PM2.5 and regulations"


def test_paged_source(tmp_path, spark):
    found = list(pages.windows(date(2024, 1, 1), date(2024, 1, 8), lambda a, b: 4000 * ((b - a).days + 1)))
    assert found == [(date(2024, 1, d), date(2024, 1, d + 1)) for d in (1, 3, 5, 7)]
    site = {"a": {"results": [{"title": 7, "correction_of": {"document_number": "x"}}], "next_page_url": "b"}, "b": {"results": [{"title": " "}], "next_page_url": "a"}}
    rows = [pages.lenient(r) for r in pages.drained("a", lambda u: json.dumps(site[u]).encode())]
    assert [(r[1], r[-1]) for r in rows] == [("7", "x"), (None, None)]
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "0"}, None)
        return io.BytesIO(b"ok")

    assert pages.fetch("u", flaky, lambda s: None) == b"ok" and len(calls) == 3
    (tmp_path / "p.json").write_text(json.dumps(site["a"]))
    assert [(r.title, r.correction_of) for r in pages.stored_pages(spark, str(tmp_path)).collect()] == [("7", "x")]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from codicil.sources.tables import table
    from codicil.streaming import queue

    log = workflow.from_events(table(spark, sf_dir, "events"))
    log.write.parquet(str(tmp_path / "log"))
    stream = queue.replayed(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    done = stream.writeStream.format("memory").queryName("replayed").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = {(r.record, r.state, r.token, r.stale) for r in spark.table("replayed").collect()}
    assert got == {(r.record, r.state, r.token, r.stale) for r in workflow.current_state(log).collect()}

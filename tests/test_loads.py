"""Transactional loads and the chain of body addresses, with injected failures."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codicil.operators import load
from codicil.sources import bodies, staged
from codicil.sources.working import Tables

DOCUMENTS = "document_number string, title string, document_type string, publication_date date, parse_error string, source_xml_sha256 string, n_residual int"
WINDOW = {"since": date(2024, 1, 1), "until": date(2024, 12, 31), "query": {"type": "RULE"}, "source": "test"}


def documents(spark, numbers, day=date(2024, 3, 1), error=None):
    return spark.createDataFrame([(n, "T", "Rule", day, error, "00", 0) for n in numbers], DOCUMENTS)


def sections(spark, numbers, text="Text é of {}."):
    return spark.createDataFrame([(n, f"s{k}", None, text.format(n) + str(k), k) for n in numbers for k in range(2)], load.SECTIONS)


def test_load_and_manifest(spark, tmp_path):
    corpus = load.Corpus(spark, f"file://{tmp_path}")
    names = [f"d{i:02d}" for i in range(30)]
    assert corpus.run("r1", documents(spark, names), sections(spark, names), **WINDOW) == load.SUCCEEDED
    last = corpus.runs().first()
    assert (last.status, json.loads(last.counts)) == ("SUCCEEDED", {"documents": 30, "parse_failures": 0, "inserted": 30, "unchanged": 0, "sections": 60})
    assert [r.status for r in corpus.log().orderBy("step").collect()] == ["RUNNING", "SUCCEEDED"]
    # the version is the hash of the canonical JSON that a plain writer makes
    files = staged.committed(f"file://{tmp_path}", "r1")
    hashed = {n: hashlib.sha256("\n\n".join(f"Text é of {n}.{k}" for k in range(2)).encode()).hexdigest() for n in names}
    body = {
        "source": "test", "query": {"type": "RULE", "since": "2024-01-01", "until": "2024-12-31", "incremental": False}, "document_count": 30, "section_count": 60, "git_sha": None,
        "documents": [{"document_number": n, "content_sha256": hashed[n], "source_xml_sha256": "00", "section_count": 2} for n in names],
        "files": [{"path": f["path"], "sha256": f["sha256"]} for f in files],
    }
    assert last.dataset_version == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    for f in files:
        assert hashlib.sha256(Path(f"{tmp_path}/{f['path']}").read_bytes()).hexdigest() == f["sha256"]
    rows = staged.staged(spark, f"file://{tmp_path}", "r1", load.SECTIONS)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, sections(spark, names).collect()))
    with pytest.raises(Exception, match="there already"):  # a run is committed once
        staged.stage(sections(spark, names), f"file://{tmp_path}", "r1")
    assert {r.dataset_version for r in corpus.current().collect()} == {last.dataset_version}


def test_a_failed_task_leaves_no_load(spark, tmp_path):
    corpus = load.Corpus(spark, f"file://{tmp_path}")
    corpus.run("r1", documents(spark, ["a"]), sections(spark, ["a"]), **WINDOW)
    before = sorted(map(tuple, corpus.current().collect()))
    names = ["a", "b", "c"]

    @F.udf("string")
    def breaks(text):
        if "b" in text.split()[-1]:
            raise RuntimeError("lost")
        return text

    folder = f"file://{tmp_path}"
    with pytest.raises(Exception, match="lost"):
        staged.stage(sections(spark, names).repartition(3).withColumn("text", breaks("text")), folder, "broken")
    assert staged.committed(folder, "broken") == [] and staged.staged(spark, folder, "broken", load.SECTIONS).count() == 0
    assert not list(Path(f"{tmp_path}/commits").glob("broken*"))
    with pytest.raises(Exception, match="lost"):
        corpus.run("r2", documents(spark, names), sections(spark, names).withColumn("text", breaks("text")), **WINDOW)
    state = {r.run_id: (r.status, r.error) for r in corpus.runs().collect()}
    assert state["r2"][0] == "FAILED" and len(state["r2"][1]) <= load.ERROR_CHARS
    assert sorted(map(tuple, corpus.current().collect())) == before
    assert corpus.run("r3", documents(spark, names), sections(spark, names), **WINDOW) == load.SUCCEEDED
    assert {(r.document_number, r.version) for r in corpus.current().collect()} == {(n, 1) for n in names}


def test_gate_and_increments(spark, tmp_path):
    corpus = load.Corpus(spark, f"file://{tmp_path}")
    assert corpus.run("bad", documents(spark, ["a", "a"]), sections(spark, ["a"]), **WINDOW) == load.FAILED
    assert corpus.runs().first().error == "duplicate_document_numbers" and corpus.head() == 0 and corpus.watermark() is None
    both = documents(spark, ["a"], date(2024, 2, 1)).union(documents(spark, ["b"], date(2024, 5, 1)))
    corpus.run("one", both.where("document_number = 'a'"), sections(spark, ["a"]), **WINDOW)
    assert corpus.watermark() == date(2024, 2, 1)
    corpus.run("two", both, sections(spark, ["a", "b"], "New {} text "), incremental=True, **WINDOW)
    got = {r.document_number: (r.version, r.status) for r in corpus.current().collect()}
    assert got == {"a": (1, "ACTIVE"), "b": (1, "ACTIVE")} and corpus.watermark() == date(2024, 5, 1)  # a is before the window now
    assert json.loads(corpus.runs().where("run_id = 'two'").first().params)["since"] == "2024-02-02"
    corpus.run("three", both, sections(spark, ["a", "b"], "New {} text "), **WINDOW)
    assert {(r.document_number, r.version, r.status) for r in corpus.current().collect()} == {("a", 1, "RETIRED"), ("a", 2, "ACTIVE"), ("b", 1, "ACTIVE")}
    short = {**WINDOW, "until": date(2024, 4, 1)}
    assert corpus.run("four", both, sections(spark, ["a"]), incremental=True, **short) == load.SUCCEEDED
    assert json.loads(corpus.runs().where("run_id = 'four'").first().counts) == {"documents": 0, "inserted": 0}


def test_two_loads_from_one_snapshot(spark, tmp_path):
    corpus = load.Corpus(spark, f"file://{tmp_path}")
    staged.write_once(f"file://{tmp_path}", "heads/1.json", b"{}")
    with pytest.raises(ValueError, match="there already"):
        staged.write_once(f"file://{tmp_path}", "heads/1.json", b"{}")
    assert corpus.head() == 1


# bodies

XML = "<RULE><PREAMB><ACT><P>Final rule.</P></ACT></PREAMB><FRDOC>[FR Doc. {}]</FRDOC></RULE>"
ISSUE = ("<FEDREG>" + XML.format("2024-05") + XML.format("2024-06") + XML.format("2024-15") + "</FEDREG>").encode()
PAGES = {
    "x/1": XML.format("2024-01").encode(),
    "x/2": b"<!DOCTYPE html><html>Request access</html>", "t/2": b"I. Background\n\nPlain words.",
    "x/4": ISSUE.replace(b"2024-06", b"2024-04"),
    "x/5": b"   ", "t/5": b"<html>",
    "issue/2024-03-01": ISSUE, "issue/2024-03-02": b"<html>no issue</html>",
}


def transport(log):
    def make():
        def read(url):
            with open(log, "a", encoding="utf-8") as f:
                f.write(url + "\n")
            if url not in PAGES:
                raise OSError("404")
            return PAGES[url]

        return read

    return make


def test_body_chain(spark, tmp_path):
    log, day, next_day = str(tmp_path / "log"), date(2024, 3, 1), date(2024, 3, 2)
    rows = [
        ("2024-01", day, "x/1", "t/1"), ("2024-02", day, "x/2", "t/2"), ("2024-03", day, "x/3", None), ("2024-04", day, "x/4", None), ("2024-05", day, "x/5", "t/5"),
        ("2024-06", day, None, None), ("2024-07", next_day, None, "t/7"), ("2024-08", None, None, None), ("2024-09", day, "x/9", "t/9"),
    ]
    given = spark.createDataFrame(rows, "document_number string, publication_date date, full_text_xml_url string, raw_text_url string")
    have = spark.createDataFrame([("2024-09", bytearray(b"<RULE>old</RULE>"))], "document_number string, body binary")
    tables = Tables(spark, "bodies")
    got = {r.document_number: r for r in bodies.bodies(given, have, tables.save, transport(log), "issue/{day}").collect()}
    assert {n: r.origin for n, r in got.items()} == {
        "2024-01": "xml", "2024-02": "text", "2024-03": None, "2024-04": "xml", "2024-05": "issue", "2024-06": "issue", "2024-07": None, "2024-08": None, "2024-09": "stored",
    }
    assert bytes(got["2024-01"].body) == PAGES["x/1"] and bytes(got["2024-02"].body) == PAGES["t/2"] and bytes(got["2024-09"].body) == b"<RULE>old</RULE>"
    for n in ("2024-04", "2024-05", "2024-06"):  # the document's part of an issue, and of no other document
        assert f"FR Doc. {n}]" in bytes(got[n].body).decode() and bytes(got[n].body).count(b"FRDOC") == 2
    assert got["2024-03"].error == "x/3: 404; 2024-03 is not in the issue"
    assert got["2024-05"].error == "x/5: no body; t/5: no body"
    assert "no XML" in got["2024-07"].error and got["2024-08"].error == "no day" and got["2024-01"].error is None
    asked = open(log, encoding="utf-8").read().split()
    assert asked.count("issue/2024-03-01") == 1 and len(asked) == len(set(asked)) and "x/9" not in asked  # one read for each address


def test_empty_chain(spark, tmp_path):
    given = spark.createDataFrame([], "document_number string, publication_date date, full_text_xml_url string, raw_text_url string")
    have = spark.createDataFrame([], "document_number string, body binary")
    assert bodies.bodies(given, have, Tables(spark, "bodies").save, transport(str(tmp_path / "log"))).count() == 0

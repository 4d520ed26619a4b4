"""Bodies of documents from the first place that has them: stored ones, the XML address, the text address, the day's issue file.

Stored bodies are a table, so documents that it has are found by a join and never asked for. The others are fetched in tasks, by
address after address; what is still missing is looked up in its day's issue, which one task reads once for all of the day's
documents. Every row says where its body came from and what went wrong on the way; an error is a value and stops no other row.
"""

from __future__ import annotations

import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.config import PASSAGE_CHARS
from codicil.sources.pages import fetch
from codicil.sources.regulations import document_element, kind_of

BODY = "document_number string, publication_date date, origin string, body binary, error string"
STORED, XML, TEXT, ISSUE = "stored", "xml", "text", "issue"
#: Fixed value: place of a day's issue file.
ISSUE_URL = "https://www.govinfo.gov/content/pkg/FR-{day}/xml/FR-{day}.xml"

#: Makes, once for each task, what reads an address.
Transport = Callable[[], Callable[[str], bytes]]


def over_http() -> Callable[[str], bytes]:
    return lambda url: fetch(url, urllib.request.urlopen)


def usable(body: bytes, number: str) -> bytes | None:
    """A body as it is, the document's part of an issue, or nothing for an access page and a blank one."""
    kind = kind_of(body)
    if kind == "html" or not body.strip():
        return None
    if kind == "xml" and b"<FEDREG" in body[:400].upper():
        return part_of(body, number)
    return body


def part_of(issue: bytes, number: str) -> bytes | None:
    """The document's element of an issue file."""
    try:
        return ET.tostring(document_element(issue, number), encoding="utf-8")
    except ValueError:
        return None


def _tried(url: str | None, number: str, read: Callable[[str], bytes], errors: list[str]) -> bytes | None:
    if not url:
        return None
    try:
        body = usable(read(url), number)
    except (OSError, ValueError, ET.ParseError) as e:
        errors.append(f"{url}: {e}")
        return None
    if body is None:
        errors.append(f"{url}: no body")
    return body


def by_address(missing: DataFrame, transport: Transport) -> DataFrame:
    """BODY of documents (document_number, publication_date, full_text_xml_url, raw_text_url); body is null where no address has one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = transport()
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                errors: list[str] = []
                origin, body = None, None
                for origin, url in ((XML, r.full_text_xml_url), (TEXT, r.raw_text_url)):
                    body = _tried(url, r.document_number, read, errors)
                    if body is not None:
                        break
                out.append((r.document_number, r.publication_date, origin if body is not None else None, body, "; ".join(errors) or None))
            yield pd.DataFrame(out, columns=["document_number", "publication_date", "origin", "body", "error"])

    return missing.select("document_number", "publication_date", "full_text_xml_url", "raw_text_url").mapInPandas(run, BODY)


def by_issue(missing: DataFrame, transport: Transport, address: str = ISSUE_URL) -> DataFrame:
    """BODY of documents (document_number, publication_date, error) from their days' issues."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        issue, problem = None, None
        if key[0] is None or pd.isna(key[0]):
            problem = "no day"
        else:
            url = address.format(day=key[0].isoformat())
            try:
                issue = transport()(url)
                if kind_of(issue) != "xml":
                    issue, problem = None, f"{url}: no XML"
                else:
                    ET.fromstring(issue)
            except (OSError, ValueError, ET.ParseError) as e:
                issue, problem = None, f"{url}: {e}"
        found = [part_of(issue, n) if issue is not None else None for n in rows["document_number"]]
        errors = [e if b is not None else "; ".join(filter(None, [e if isinstance(e, str) else None, problem or f"{n} is not in the issue"])) for n, b, e in zip(rows["document_number"], found, rows["error"], strict=True)]
        return pd.DataFrame({"document_number": rows["document_number"], "publication_date": rows["publication_date"], "origin": [ISSUE if b is not None else None for b in found], "body": found, "error": errors})

    return missing.select("document_number", "publication_date", "error").groupBy("publication_date").applyInPandas(run, BODY)


def bodies(documents: DataFrame, stored: DataFrame, save: Callable[[DataFrame, str], DataFrame], transport: Transport = over_http, address: str = ISSUE_URL) -> DataFrame:
    """BODY of each of documents, with the rows to be stored next time marked by their origin.

    stored: (document_number, body); save writes a table and reads it back, so that no address is asked twice.
    """
    have = stored.select("document_number", "body")
    known = documents.select("document_number", "publication_date").join(have, "document_number").select("document_number", "publication_date", F.lit(STORED).alias("origin"), "body", F.lit(None).cast("string").alias("error"))
    asked = save(by_address(documents.join(have.select("document_number"), "document_number", "left_anti"), transport), "by-address")
    rest = save(by_issue(asked.where("body IS NULL"), transport, address), "by-issue")
    rows = known.unionByName(asked.where("body IS NOT NULL")).unionByName(rest)
    return rows.withColumn("error", F.left("error", F.lit(PASSAGE_CHARS)))

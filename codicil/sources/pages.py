"""Paged search results as a Spark source: date windows as partitions, with retries inside the task."""

from __future__ import annotations

import email.utils
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows after which a window must be split, rows of a page, retries and waits in seconds.
WINDOW_ROWS, PAGE_ROWS, ATTEMPTS, LONGEST_WAIT, JITTER = 10_000, 1000, 5, 30.0, 0.25
RETRIED = (429, 500, 502, 503, 504)

SCHEMA = """document_number string, title string, type string, publication_date string, effective_on string, citation string,
    html_url string, full_text_xml_url string, raw_text_url string,
    cfr_references array<struct<title:string,part:string,chapter:string,citation_url:string>>, docket_ids array<string>, correction_of string"""


def midpoint(since: date, until: date) -> date:
    return since + timedelta(days=(until - since).days // 2)


def windows(since: date, until: date, count: Callable[[date, date], int]) -> Iterator[tuple[date, date]]:
    """Halves of the window until each has few enough rows or is one day."""
    if count(since, until) >= WINDOW_ROWS and since < until:
        middle = midpoint(since, until)
        yield from windows(since, middle, count)
        yield from windows(middle + timedelta(days=1), until, count)
    else:
        yield since, until


#: The service's names of conditions, and the members that are asked for.
CONDITIONS = {"agency": "conditions[agencies][]", "type": "conditions[type][]", "cfr": "conditions[cfr][title]"}
FIELDS = ("document_number", "title", "type", "abstract", "publication_date", "effective_on", "citation", "html_url", "full_text_xml_url", "raw_text_url", "cfr_references", "docket_ids", "correction_of", "agencies")


def query_url(base: str, since: date, until: date, per_page: int = PAGE_ROWS, **conditions: str | None) -> str:
    """First page of a window, oldest first; conditions by the keys of CONDITIONS."""
    pairs = [(name, str(conditions[k])) for k, name in CONDITIONS.items() if conditions.get(k)]
    pairs += [("conditions[publication_date][gte]", since.isoformat()), ("conditions[publication_date][lte]", until.isoformat())]
    pairs += [("per_page", str(min(max(per_page, 1), PAGE_ROWS))), ("order", "oldest"), *(("fields[]", f) for f in FIELDS)]
    return f"{base}?{urllib.parse.urlencode(pairs)}"


def wait_before(attempt: int, retry_after: str | None, now: datetime | None = None) -> float:
    """Seconds before the next attempt: what the server asks for, as seconds or a date, else doubling with jitter."""
    if retry_after:
        try:
            return max(0.0, float(retry_after))
        except ValueError:
            at = email.utils.parsedate_to_datetime(retry_after)
            return max(0.0, (at - (now or datetime.now(timezone.utc))).total_seconds())
    return min(LONGEST_WAIT, 0.5 * 2**attempt) + random.random() * JITTER


def fetch(url: str, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> bytes:
    for attempt in range(ATTEMPTS):
        try:
            with opener(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or attempt + 1 == ATTEMPTS:
                raise
            sleep(wait_before(attempt, e.headers.get("Retry-After") if e.headers else None))
        except urllib.error.URLError:
            if attempt + 1 == ATTEMPTS:
                raise
            sleep(wait_before(attempt, None))
    raise RuntimeError("unreachable")


def drained(url: str, read: Callable[[str], bytes], most: int | None = None) -> Iterator[dict]:
    """Results of a page and those that follow it, until there is none, a page repeats or there are enough."""
    seen: set[str] = set()
    n = 0
    while url and url not in seen:
        seen.add(url)
        page = json.loads(read(url))
        for row in page.get("results") or ():
            if most is not None and n >= most:
                return
            n += 1
            yield row
        url = page.get("next_page_url")


def lenient(row: dict) -> tuple:
    """A result in SCHEMA's order: blanks are null, numbers become text, a correction may be text or an object."""
    text = lambda v: (str(v).strip() or None) if v is not None else None
    correction = row.get("correction_of")
    if isinstance(correction, dict):
        correction = correction.get("document_number")
    names = ("document_number", "title", "type", "publication_date", "effective_on", "citation", "html_url", "full_text_xml_url", "raw_text_url")
    references = [tuple(text(r.get(k)) for k in ("title", "part", "chapter", "citation_url")) for r in row.get("cfr_references") or () if isinstance(r, dict)]
    return (*(text(row.get(k)) for k in names), references, [text(d) for d in row.get("docket_ids") or () if text(d)], text(correction))


class Window(InputPartition):
    def __init__(self, since: date, until: date):
        super().__init__((since, until))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.most = options["url"], int(options["most"]) if "most" in options else None
        self.since, self.until = (date.fromisoformat(options[k]) for k in ("since", "until"))
        self.conditions = {k: options.get(k) for k in ("agency", "type", "cfr")}

    def _url(self, since: date, until: date, per_page: int = PAGE_ROWS) -> str:
        return query_url(self.base, since, until, per_page, **self.conditions)

    def partitions(self) -> list[Window]:
        count = lambda a, b: int(json.loads(fetch(self._url(a, b, 1))).get("count") or 0)
        return [Window(a, b) for a, b in windows(self.since, self.until, count)]

    def read(self, partition: Window) -> Iterator[tuple]:
        for row in drained(self._url(*partition.value), fetch, self.most):
            yield lenient(row)


class PagedSource(DataSource):
    """``spark.read.format("regulation_pages")`` with options url, since, until and optional conditions."""

    @classmethod
    def name(cls) -> str:
        return "regulation_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(dict(self.options))


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Results of cached pages (JSON files), one row each, with lenient values."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("page"))
    items = raw.select(F.explode(F.from_json(F.to_json("page"), "struct<results:array<string>>")["results"]).alias("r")).select(F.parse_json("r").alias("v"))
    get = lambda path: F.nullif(F.trim(F.try_variant_get("v", f"$.{path}", "string")), F.lit(""))
    plain = [get(k).alias(k) for k in ("document_number", "title", "type", "publication_date", "effective_on", "citation", "html_url", "full_text_xml_url", "raw_text_url")]
    members = lambda path: F.from_json(F.to_json(F.try_variant_get("v", f"$.{path}", "variant")), "array<variant>")
    text = lambda v, path: F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    names = ("title", "part", "chapter", "citation_url")
    references = F.transform(F.coalesce(members("cfr_references"), F.array().cast("array<variant>")), lambda r: F.struct(*(text(r, f"$.{n}").alias(n) for n in names)))
    dockets = F.array_compact(F.transform(F.coalesce(members("docket_ids"), F.array().cast("array<variant>")), lambda d: text(d, "$")))
    return items.select(*plain, references.alias("cfr_references"), dockets.alias("docket_ids"), correction(F.col("v")).alias("correction_of"))


def correction(v: Column) -> Column:
    """The corrected document's number of a variant: a member of an object, else the text itself."""
    own = F.try_variant_get(v, "$.correction_of.document_number", "string")
    text = F.when(F.schema_of_variant(F.try_variant_get(v, "$.correction_of", "variant")) == "STRING", F.try_variant_get(v, "$.correction_of", "string"))
    return F.coalesce(own, F.nullif(F.trim(text), F.lit("")))

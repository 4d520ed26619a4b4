"""Labels, counts and dates out of loosely typed JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Title whose label is preferred, and the label of a document without any.
PREFERRED, NO_LABEL = "40:", "other"
_NUMBER_OR_TEXT = "^(BIGINT|STRING|DECIMAL\\(\\d+,0\\))$"


def _variants(json: Column) -> Column:
    """Members of a JSON array; null for other JSON and for text that isn't JSON."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def part_labels(references: Column) -> Column:
    """``title:part`` of each object of a JSON array, distinct and in order.

    Both are whole numbers or text, never booleans; a part is trimmed and not blank. What isn't an array has no labels.
    """
    get = lambda r, name: F.try_variant_get(r, f"$.{name}", "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v).rlike(_NUMBER_OR_TEXT), F.lit(False))
    text = lambda v: F.try_variant_get(v, "$", "string")
    part = lambda r: F.trim(text(get(r, "part")))
    label = lambda r: F.when(kind(get(r, "title")) & kind(get(r, "part")) & (part(r) != ""), F.concat_ws(":", text(get(r, "title")), part(r)))
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(_variants(references), label))), F.array().cast("array<string>"))


def preferred_label(labels: Column) -> Column:
    """The first label of the preferred title, else the first, else NO_LABEL."""
    return F.coalesce(F.get(F.filter(labels, lambda x: F.startswith(x, F.lit(PREFERRED))), F.lit(0)), F.get(labels, F.lit(0)), F.lit(NO_LABEL))


def count_map(json: Column) -> Column:
    """Whole-number members of a JSON object as map<string,bigint>; other members are left out, other JSON is an empty map."""
    v = F.try_parse_json(json)
    members = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    whole = F.map_filter(members, lambda _, x: F.coalesce(F.schema_of_variant(x) == "BIGINT", F.lit(False)))
    counts = F.transform_values(whole, lambda _, x: F.try_variant_get(x, "$", "bigint"))
    return F.coalesce(counts, F.create_map().cast("map<string,bigint>"))


def of_width(vector: Column, size: int) -> Column:
    """The vector, or an error where it hasn't ``size`` numbers."""
    return F.when(F.size(vector) == size, vector).otherwise(F.raise_error(F.concat(F.lit(f"a vector must have {size} numbers, not "), F.size(vector).cast("string"))))


def as_date(value: Column) -> Column:
    """Date of a text's first ten characters; null if they are none."""
    return F.try_to_timestamp(F.left(value, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")


def effective_from(effective_on: Column, published: Column) -> Column:
    """struct(date, source): the effective date, else the publication date, and which of them it is."""
    source = F.when(effective_on.isNotNull(), "effective_on").when(published.isNotNull(), "publication_date")
    return F.struct(F.coalesce(effective_on, published).alias("date"), source.alias("source"))

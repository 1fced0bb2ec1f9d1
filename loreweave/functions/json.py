"""Columns that hold JSON as text, read so that broken rows become defaults and can be told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _of_kind(text: Column | str, kind: str) -> Column:
    """Whether the text is JSON of a kind (OBJECT or ARRAY)."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(_col(text))).startswith(kind), F.lit(False))


def json_list(text: Column | str) -> Column:
    """array<string> of a JSON list; empty for null, empty and broken text and for JSON that is no list."""
    return F.when(_of_kind(text, "ARRAY"), F.coalesce(F.from_json(_col(text), "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def json_map(text: Column | str) -> Column:
    """map<string,string> of a JSON object; empty for null, empty and broken text and for JSON that is no object. Values that nest stay JSON text."""
    none = F.create_map().cast("map<string,string>")
    return F.when(_of_kind(text, "OBJECT"), F.coalesce(F.from_json(_col(text), "map<string,string>"), none)).otherwise(none)


def broken_json(text: Column | str) -> Column:
    """Whether there is text that is no JSON; null and empty text is none, and not broken."""
    return F.coalesce((_col(text) != "") & F.try_parse_json(_col(text)).isNull(), F.lit(False))

"""Strict JSON parsing and the feature-line rules.

``from_json`` accepts text after the first object. Parsing ``[<line>,null,null,null]`` as an array instead makes the
parser read the line to its end, and a line is one valid object exactly when the array has four elements (unless the
line itself holds ``,null,null,null]`` outside a text). Duplicate names keep the last value.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from contextlib import suppress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.binding import let, only_if
from sparkweft.functions.text import trim_ws

# Fixed value: the prefix that marks a wanted member of a feature line.
MEMBER_PREFIX = "merge_field\t"

_STRICT = {"allowSingleQuotes": "false"}
_END_MARK = ",null,null,null]"
_ELEMENTS = 4


def parse_object(text: Column, fields: T.StructType) -> Column:
    """One JSON object as a struct; NULL for anything else (blank, malformed, array, scalar, trailing text).

    A field whose value does not fit its type is NULL and does not spoil the others.

    The parser ignores what follows a document, so the text is read as the first of four elements of an array. A line could
    bring the other elements and the end of the array itself; one that has what this takes is looked through again as a member of an
    object with another member behind it. Whatever goes on behind a first object can't be right in both.
    """
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(_END_MARK)), T.ArrayType(fields), _STRICT)
    found = F.get(only_if(parsed, lambda elements: F.size(elements) == _ELEMENTS), F.lit(0))
    behind = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit(',"end":1}')), "$.end")
    return F.when(~text.rlike(r"(?s)\}\s*,.*\]") | (behind == "1"), found)


def _text_fields(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def wanted_members(members: Column, prefix: str = MEMBER_PREFIX) -> Column:
    """Members with the prefix, repeats removed, first occurrence first; no list gives an empty list."""
    kept = F.array_distinct(F.filter(members, lambda member: member.startswith(prefix)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def feature_fields(key_field: str = "key", list_field: str = "fieldvalues") -> T.StructType:
    """Schema of the two interesting fields of a feature line."""
    return T.StructType(
        [
            T.StructField(key_field, T.StringType()),
            T.StructField(list_field, T.ArrayType(T.StringType())),
        ]
    )


def has_wanted_member(line: Column, list_field: str = "fieldvalues", prefix: str = MEMBER_PREFIX) -> Column:
    """True when a valid line has at least one member with the prefix."""
    fields = T.StructType([T.StructField(list_field, T.ArrayType(T.StringType()))])
    members = parse_object(line, fields)[list_field]
    return F.coalesce(F.exists(members, lambda member: F.coalesce(member.startswith(prefix), F.lit(False))), F.lit(False))


def _object_of(line: str) -> dict | None:
    with suppress(ValueError, RecursionError):
        found = json.loads(line)
        return found if type(found) is dict else None
    return None


def keep_wanted_members(line: str | None, list_field: str, prefix: str) -> str | None:
    """One line with its member list cut to the wanted texts, each once; any line but a JSON object stays as it is."""
    record = _object_of(line) if line else None
    if record is None:
        return line
    match record.get(list_field):
        case [*members]:
            texts = dict.fromkeys(m for m in members if isinstance(m, str))
            record |= {list_field: [m for m in texts if m.startswith(prefix)]}
    return json.dumps(record, ensure_ascii=False)


def rewrite_members(line: Column, list_field: str = "fieldvalues", prefix: str = MEMBER_PREFIX) -> Column:
    """Whole line with its member list filtered, in Arrow batches.

    The other fields keep their order, which no built-in expression does; numbers come out as Python writes them.
    """

    @F.pandas_udf(T.StringType())
    def rewrite(lines: pd.Series) -> pd.Series:
        return lines.map(lambda value: keep_wanted_members(value, list_field, prefix), na_action="ignore")

    return rewrite(line)


def params_struct(line: Column, names: Sequence[str]) -> Column:
    """Named ``params`` fields of a log line, as a struct of texts; NULL when the line has none.

    Looked for in this order: a JSON line with an object under ``params``; ``"params": {…}`` inside the text;
    ``params={…}`` or ``params: {…}``. The found object is parsed as it is, then with single quotes turned into
    double quotes. An empty object counts as none. Values that are not text come out as JSON text.
    """
    fields = _text_fields(names)
    as_map = T.MapType(T.StringType(), T.StringType())
    in_line = T.StructType([T.StructField("params", fields)])
    in_line_map = T.StructType([T.StructField("params", as_map)])

    def of_line(clean: Column) -> Column:
        quoted = F.regexp_extract(clean, r'(?U)"params"\s*:\s*(\{.*\})', 1)
        bare = F.regexp_extract(clean, r"(?U)\bparams\s*[:=]\s*(\{.*\})", 1)
        from_text = let(F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit(""))), of_text)
        not_empty = F.size(parse_object(clean, in_line_map)["params"]) > 0
        return let(
            parse_object(clean, in_line)["params"],
            lambda found: F.when(F.coalesce(*[found[name] for name in names]).isNotNull(), found)
            .when(found.isNotNull(), F.when(not_empty, found))
            .otherwise(from_text),
        )

    def of_text(found: Column) -> Column:
        swapped = F.replace(found, F.lit("'"), F.lit('"'))
        parsed = F.coalesce(parse_object(found, fields), parse_object(swapped, fields))
        return F.when(~F.coalesce(found.rlike(r"^\{\s*\}$"), F.lit(True)), parsed)

    return let(trim_ws(line), of_line)


def unfenced(text: Column) -> Column:
    """Content of the first code fence, or the whole text, trimmed; NULL for blank text."""
    fence = r"```(?:json)?\s*([\s\S]*?)\s*```"
    body = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    return F.when(trim_ws(text) != "", trim_ws(body))


def parse_answer(text: Column, fields: T.StructType) -> Column:
    """A model answer, fenced or bare, as a struct; NULL when it is no JSON object.

    Both steps use their input several times, so the answer and its unfenced body are each evaluated once per row.
    """
    return let(text, lambda answer: let(unfenced(answer), lambda body: parse_object(body, fields)))


# The fields of a trip answer.
TRIP_FIELDS = ("start_point", "end_point", "order_estimated_distance", "order_estimated_time", "creation_time")
VEHICLE_FIELDS = ("supplier", "price", "price_type", "discount_type", "discount_amount", "extra_price")

TRIP_ANSWER = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in TRIP_FIELDS],
        T.StructField("vehicles", T.ArrayType(_text_fields(VEHICLE_FIELDS))),
    ]
)

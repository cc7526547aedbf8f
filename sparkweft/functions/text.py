"""Text functions: trimming, splitting, CSV cells, log captures."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = f"[{WHITESPACE}]+"
_TO_END = 2**31 - 1


def trim_ws(text: Column) -> Column:
    """Strip Unicode white space, U+3000 included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for a text that is empty after :func:`trim_ws`; NULL stays NULL."""
    return trim_ws(text) == ""


def split_fields(text: Column, delimiter: str = "\t") -> Column:
    """Cells between delimiters; trailing empty cells are kept."""
    return F.split(text, re.escape(delimiter), -1)


def split_pair(text: Column) -> Column:
    """First word and the rest, as an array of two; an array of one when there is no rest."""
    return F.split(trim_ws(text), _SPACE_RUN, 2)


def cell_at(cells: Column, position: int, default: str | None = "") -> Column:
    """Cell at a zero-based position, or ``default`` when the row is too short."""
    found = F.try_element_at(cells, F.lit(position + 1))
    return found if default is None else F.coalesce(found, F.lit(default))


def _command_pattern(name: str) -> str:
    return rf"{re.escape(name)}=([^{WHITESPACE}]+)"


def has_command(text: Column, name: str = "cmd") -> Column:
    """Whether there is a token after ``name=``."""
    return text.rlike(_command_pattern(name))


def command_value(text: Column, name: str = "cmd") -> Column:
    """The token after ``name=`` up to white space; ``''`` when absent."""
    return F.regexp_extract(text, _command_pattern(name), 1)


def contains_marker(text: Column, marker: str) -> Column:
    """Plain substring test, NULL text counting as no match."""
    return F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))


def correct_text(text: Column, corrections: Mapping[str, str]) -> Column:
    """Replace a text that equals a known misreading; other texts stay."""
    if not corrections:
        return text
    pairs = [F.lit(part) for item in corrections.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text)


def zero_pad(number: Column, width: int = 5) -> Column:
    """Pad on the left with zeros; longer texts are not cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def csv_cell(text: Column, delimiter: str = ",") -> Column:
    """Quote a cell only when it needs it; NULL becomes an empty cell."""
    cell = F.coalesce(text, F.lit(""))
    special = "[" + re.escape(delimiter) + '"\\r\\n]'
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cell.rlike(special), quoted).otherwise(cell)


def csv_line(cells: Sequence[Column], delimiter: str = ",") -> Column:
    """Cells joined into one CSV record with minimal quoting."""
    return F.concat_ws(delimiter, *[csv_cell(cell.cast("string"), delimiter) for cell in cells])


def csv_cells(record: Column, delimiter: str = ",") -> Column:
    """Cells of one CSV record as an array of any length.

    Quotes matter only at the start of a cell, doubled quotes stand for one, and text after a closing quote is
    kept. Records without a quote take the plain split.
    """
    stop = re.escape(delimiter)
    cell = stop + rf'(?:"(?:[^"]++|"")*+(?:"[^{stop}]*+)?|[^{stop}]*+)'
    quoted = r'(?s)^"((?:[^"]++|"")*+)(?:"(.*))?$'

    def unquote(piece: Column) -> Column:
        inner = F.replace(F.regexp_extract(piece, quoted, 1), F.lit('""'), F.lit('"'))
        return F.when(piece.startswith('"'), F.concat(inner, F.regexp_extract(piece, quoted, 2))).otherwise(piece)

    pieces = F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(cell), F.lit(0))
    bodies = F.transform(pieces, lambda piece: F.substring(piece, 1 + len(delimiter), _TO_END))
    return F.when(F.contains(record, F.lit('"')), F.transform(bodies, unquote)).otherwise(
        split_fields(record, delimiter)
    )


def quoted_pair(record: Column) -> Column:
    """A ``"dict","key"`` record as a struct of two texts."""
    cells = csv_cells(record)
    return F.struct(cell_at(cells, 0, None).alias("dict"), cell_at(cells, 1, None).alias("key"))


def utf8_bytes(text: Column) -> Column:
    """Length in bytes when written as UTF-8."""
    return F.octet_length(text).cast("long")


def base64_text(content: Column) -> Column:
    """Base64 of binary content, without line breaks."""
    return F.regexp_replace(F.base64(content), r"\r?\n", "")


def file_parent(path: Column) -> Column:
    """Everything before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def parent_name(path: Column) -> Column:
    """Second-to-last path segment; the path itself when it has one segment."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(path)


def segment_between(path: Column, before: str, after: str) -> Column:
    """The segment between two named segments (the last such place); the path itself when they are absent."""
    pattern = rf".*/{re.escape(before)}/([^/]*)/{re.escape(after)}/.*"
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(path)


def swap_segment(path: Column, old: str, new: str) -> Column:
    """Replace the first path segment equal to ``old``; NULL when there is none."""
    trimmed = F.rtrim(path, F.lit("/"))
    pattern = rf"(?s)^((?:.*?/)?){re.escape(old)}(/.*)?$"
    return F.when(
        trimmed.rlike(pattern),
        F.concat(F.regexp_extract(trimmed, pattern, 1), F.lit(new), F.regexp_extract(trimmed, pattern, 2)),
    )


def with_scheme(path: Column, scheme: str = "hdfs://") -> Column:
    """Put the scheme in front of a path that lacks it."""
    clean = trim_ws(path)
    rooted = F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))
    return F.when(clean.startswith(scheme), clean).otherwise(F.concat(F.lit(scheme), rooted))


def request_pairs(text: Column) -> Column:
    """All ``(dict, key)`` structs of the first entries of ``"keys": [{"key": …, "dict": …}]`` in a text, in order."""
    entry = r'"keys":\s*\[\s*\{\s*"key":\s*"([^"]+)"\s*,\s*"dict":\s*"([^"]+)"'
    dicts = F.regexp_extract_all(text, F.lit(entry), F.lit(2))
    keys = F.regexp_extract_all(text, F.lit(entry), F.lit(1))
    return F.zip_with(dicts, keys, lambda d, k: F.struct(d.alias("dict"), k.alias("key")))

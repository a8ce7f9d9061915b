"""Column expressions for fields, rows and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(column: Column | str) -> Column:
    """A join or sort key: text compared by bytes, with a missing value as the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def clean_token(column: Column | str) -> Column:
    """The token without white space and semicolons."""
    return F.regexp_replace(column, r"[\s;]", "")


def int_prefix(column: Column | str) -> Column:
    """The integer that a text begins with, after white space; null if there is none or it is out of range."""
    return F.regexp_extract(column, r"^\s*([+-]?\d+)", 1).try_cast("int")


def split_fields(column: Column | str, separator: str = ",") -> Column:
    """Fields between separators; one empty field at the end is dropped, an empty text has no fields."""
    fields = F.split(column, f"[{separator}]", -1)
    return F.when(F.element_at(fields, -1) == "", F.slice(fields, 1, F.size(fields) - 1)).otherwise(fields)


def join_fields(columns: list[str], separator: str) -> Column:
    """One text of all fields; a missing field is the empty text."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def field(fields: Column | str, position: int) -> Column:
    """The field at a 0-based position; the empty text beyond the row's width."""
    return F.coalesce(F.get(fields, position), F.lit(""))


def zero_padded(number: Column | str, width: int = 2) -> Column:
    """A number padded with zeros to ``width``, never cut."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def base_name(column: Column | str) -> Column:
    """What stands before the first full stop."""
    return F.substring_index(column, ".", 1)

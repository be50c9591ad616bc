"""Expressions on source text and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def lines(text: Column, keep_ends: bool = False) -> Column:
    """Lines of a text by all Unicode line ends; an empty text has none, and a last line end begins no line."""
    if keep_ends:
        found = F.regexp_extract_all(text, F.lit(f"(?s).*?(?:{_BREAK})|.+$"), F.lit(0))
        return found
    found = F.split(text, _BREAK)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(found, -1) == "", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def slice_lines(text: Column, start: Column, end: Column, strip: bool = True) -> Column:
    """Lines `start` to `end`, from 1 and both included. An `end` behind the last line means the last line.

    Null if the range is invalid or begins behind the last line.
    """
    all_lines = lines(text, keep_ends=True)
    ok = (start >= 1) & (end >= start) & (start <= F.size(all_lines))
    part = F.array_join(F.slice(all_lines, F.greatest(start, F.lit(1)), F.greatest(F.least(end, F.size(all_lines)) - start + 1, F.lit(0))), "")
    return F.when(ok, F.btrim(part, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029")) if strip else part)


def tokens(text: Column) -> Column:
    """Number of tokens of a text, counted as a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def within_budget(rows: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """The longest head of the ordered rows whose summed cost stays within the budget; the first row always stays.

    The rows are a query's result, already cut to its row limit, so their window is small.
    """
    spent = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("spent", spent).withColumn("place", place).where((F.col("spent") <= budget) | (F.col("place") == 1))


def requirement(line: Column) -> Column:
    """(`name`, `extras`, `spec`, `marker`) of a requirement line: project, what is in brackets, version or URL, condition.

    Parts that are missing are empty; a line without a name gives empty parts.
    """
    # A name, one bracket group, everything up to a semicolon, the rest.
    grammar = r"^\s*([\w.-]+)\s*(?:\[([^\]]*)\])?\s*([^;]*?)\s*(?:;\s*(.*?)\s*)?$"
    part = lambda i: F.regexp_extract(line, grammar, i)
    return F.struct(part(1).alias("name"), part(2).alias("extras"), part(3).alias("spec"), part(4).alias("marker"))


def page(text: Column, offset: int, limit: int) -> Column:
    """(`first`, `last`, `total`, `lines`): `limit` lines from line `offset` (from 0), their numbers from 1, and how many there are.

    Behind the last line there are no lines, and `last` is less than `first`.
    """
    all_lines = lines(text)
    total = F.size(all_lines)
    return F.struct(F.lit(offset + 1).alias("first"), F.least(total, F.lit(offset + limit)).alias("last"), total.alias("total"), F.slice(all_lines, offset + 1, limit).alias("lines"))


def json_row(rows: DataFrame) -> Column:
    """A row as JSON text with a blank behind each comma and colon; nulls are written out."""
    items = []
    for c in rows.columns:
        value = F.substring(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), 6, 1 << 30)
        items.append(F.concat(F.lit(f'"{c}": '), F.regexp_replace(value, r"\}$", "")))
    return F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}"))


def shown(rows: DataFrame) -> DataFrame:
    """All columns as text for a table: null is empty, a truth value a tick or a cross."""
    return rows.select(*(F.coalesce(F.when(F.col(c), "\u2713").when(~F.col(c), "\u2717") if kind == "boolean" else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in rows.dtypes))


def method_of_chain(call: Column) -> Column:
    """The method at the end of a chain like `a.b().c`; empty if there is none."""
    return F.regexp_extract(call, r"\.([^.()]+)$", 1)

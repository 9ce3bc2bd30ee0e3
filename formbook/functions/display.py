"""Presentation helpers (JVM-side): labels, formatted numbers, content
blocks -> text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from formbook.functions.exprs import c

BLOCKS_TYPE = "array<struct<type:string,text:string>>"


def tool_label(col: str | Column) -> Column:
    """'get_player_form_profile' -> 'Get Player Form Profile'."""
    return F.initcap(F.regexp_replace(c(col), "_", " "))


def time_label(col: str | Column, fmt: str = "MMM dd, HH:mm") -> Column:
    """Short event time, e.g. 'Jan 05, 07:08'."""
    return F.date_format(c(col), fmt)


def fmt_num(col: str | Column, decimals: int = 1, default: str = "—") -> Column:
    """Formatted number, or a dash for NULL / NaN."""
    x = c(col)
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(
        F.format_string(f"%.{decimals}f", x.cast("double")))


def blocks_text(json_col: str | Column, drop_types: Sequence[str] = ("reasoning",), sep: str = " ") -> Column:
    """Typed content blocks (JSON text) -> joined text of the kept blocks;
    reasoning blocks are dropped."""
    blocks = F.from_json(c(json_col), BLOCKS_TYPE)
    kept = F.filter(blocks, lambda b: ~b["type"].isin(list(drop_types)))
    return F.array_join(F.transform(kept, lambda b: b["text"]), sep)

"""Values as CSV text, JVM-side but for floats, whose shortest digits Spark doesn't print."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.types import ColumnType


def float_text(value: float) -> str:
    """Shortest digits that read back as the same float: fixed from 1e-4 up to 1e16, else with an exponent."""
    text = repr(value)
    digits, mark, exponent = text.partition("e")
    return f"{digits}e{int(exponent)}" if mark else text


def _float_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield pd.Series([float_text(v) for v in values.tolist()], dtype=object)


def quoted(text: Column, delimiter: str) -> Column:
    """In quotes, with inner ones doubled, if the text holds the delimiter, a quote or a line break."""
    needs = F.lit(False)
    for mark in (delimiter, '"', "\r", "\n"):
        needs = needs | F.contains(text, F.lit(mark))
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def field(column: Column, kind: ColumnType, delimiter: str, alone: bool) -> Column:
    """A cell's CSV text. alone: it is the only one of its record, which must not look like a blank line."""
    if kind is ColumnType.INT:
        return column.cast("string")
    if kind is ColumnType.FLOAT:
        return F.pandas_udf(_float_texts, T.StringType())(column)
    text = quoted(column, delimiter)
    return F.when(column == "", F.lit('""')).otherwise(text) if alone else text


def header(names: tuple[str, ...], delimiter: str) -> str:
    """The header record, without its line break."""
    if names == ("",):
        return '""'
    special = (delimiter, '"', "\r", "\n")
    return delimiter.join('"' + n.replace('"', '""') + '"' if any(s in n for s in special) else n for n in names)

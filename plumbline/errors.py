"""Errors as ordinary Python exceptions."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.errors import ArithmeticException, PySparkException

Result = TypeVar("Result")


class ParseError(ValueError):
    """The input is not a table in the accepted grammar."""


#: What is wrong with a malformed input, by the scanner's codes.
PARSE_MESSAGES = {
    "unterminated": "an opened quote is never closed",
    "after_quote": "there is text after a closing quote",
    "ragged": "a record has a different field count from the header's",
    "no_header": "there is no header in this input",
}
NOT_NUMERIC = "only columns of numbers have this"
EMPTY_COLUMN = "there is no such value without rows"
SUM_OVERFLOW = "the sum does not fit 64 bits"
TEXT_AND_NUMBER = "text and numbers do not compare"
BAD_DELIMITER = "quotes and line breaks cannot delimit fields"


def parse_error(code: str, source: str | None) -> ParseError:
    message = PARSE_MESSAGES[code]
    return ParseError(f"{message}: {source}" if source is not None else message)


def run(action: Callable[[], Result], source: str) -> Result:
    """Runs a Spark action; a 64-bit sum that overflows becomes an OverflowError."""
    try:
        return action()
    except ArithmeticException as e:
        raise OverflowError(f"{SUM_OVERFLOW}: {source}") from e
    except PySparkException as e:
        if "ARITHMETIC_OVERFLOW" in str(e):
            raise OverflowError(f"{SUM_OVERFLOW}: {source}") from e
        raise

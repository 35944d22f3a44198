"""The record grammar in plain Python, with no Spark in it.

A field is quoted only if its first byte is a quote. In quotes everything counts but the next single quote, two stand for
one, and after the closing quote only a delimiter, a line end or the end of input may follow. A line end is LF or CRLF;
a CR elsewhere in a plain field is data. Lines that are empty where a record would start are skipped.

At the start of a line the scanner is either between records or inside a quoted field. So lines can be scanned
apart: what a stretch of them does is where it ends for either start (`ends_open`).
"""

from __future__ import annotations

from collections.abc import Iterator

QUOTE, CR, LF = 0x22, 0x0D, 0x0A


class Malformed(Exception):
    """args[0]: unterminated, after_quote, ragged or no_header."""


def records(data: bytes, delimiter: int) -> Iterator[list[bytes]]:
    """The fields of each record. Raises Malformed where the input leaves the grammar."""
    at, n = 0, len(data)
    split = bytes([delimiter])
    while True:
        while at < n:
            if data[at] == LF:
                at += 1
            elif data[at] == CR and at + 1 < n and data[at + 1] == LF:
                at += 2
            else:
                break
        if at >= n:
            return
        # a line without quotes is a plain split
        end = data.find(b"\n", at)
        stop = n if end < 0 else end
        line = data[at:stop]
        if b'"' not in line:
            if end >= 0 and line.endswith(b"\r"):
                line = line[:-1]
            yield line.split(split)
            at = stop + 1
            continue
        fields, more = [], True
        while more:
            value, at, more = _field(data, at, n, delimiter)
            fields.append(value)
        yield fields


def _field(data: bytes, at: int, n: int, delimiter: int) -> tuple[bytes, int, bool]:
    """A field from `at`: its value, where the next one or the next line starts, and whether the record goes on."""
    if at < n and data[at] == QUOTE:
        at += 1
        parts = []
        while True:
            close = data.find(b'"', at)
            if close < 0:
                raise Malformed("unterminated")
            parts.append(data[at:close])
            at = close + 1
            if at < n and data[at] == QUOTE:
                at += 1
                continue
            break
        value = b'"'.join(parts)
        if at >= n:
            return value, at, False
        if data[at] == delimiter:
            return value, at + 1, True
        if data[at] == LF:
            return value, at + 1, False
        if data[at] == CR and at + 1 < n and data[at + 1] == LF:
            return value, at + 2, False
        raise Malformed("after_quote")
    end, cut = data.find(b"\n", at), data.find(bytes([delimiter]), at)
    if cut >= 0 and (end < 0 or cut < end):
        return data[at:cut], cut + 1, True
    if end < 0:
        return data[at:n], n, False
    return data[at : end - 1 if end > at and data[end - 1] == CR else end], end + 1, False


def ends_open(inside: bool, line: bytes, delimiter: int) -> bool:
    """Whether a line (without its LF) that starts inside a quoted field, or not, ends inside one. Where it leaves the
    grammar it counts as ended; `records` finds the error."""
    at, n, split = 0, len(line), bytes([delimiter])
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(split, at) + 1
                if not at:
                    return False
                continue
            at += 1
        close = line.find(b'"', at)
        if close < 0:
            return True
        at = close + 1
        inside = line[at : at + 1] == b'"'
        if inside:
            at += 1
        elif at < n and line[at] == delimiter:
            at += 1
        else:
            return False


def table(data: bytes, delimiter: int) -> tuple[list[bytes], list[list[bytes]]]:
    """The header and the rows, all as wide as it. Raises Malformed."""
    found = records(data, delimiter)
    header = next(found, None)
    if header is None:
        raise Malformed("no_header")
    rows = []
    for record in found:
        if len(record) != len(header):
            raise Malformed("ragged")
        rows.append(record)
    return header, rows


def delimiter_byte(delimiter: str) -> int:
    """Checks a delimiter: one ASCII character that is no quote and no line end."""
    from plumbline.errors import BAD_DELIMITER

    if not isinstance(delimiter, str):
        raise TypeError(f"a delimiter is a str, not {type(delimiter).__name__}")
    if len(delimiter) != 1 or not delimiter.isascii():
        raise ValueError(f"a delimiter is one ASCII character, not {delimiter!r}")
    if delimiter in '"\r\n':
        raise ValueError(BAD_DELIMITER)
    return ord(delimiter)

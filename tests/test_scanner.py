"""The record grammar, against an independent character-by-character reading of it."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.sources.scanner import Malformed, delimiter_byte, ends_open, records, table


def slow(data: bytes, mark: int):
    """One byte at a time, states as in the grammar's prose."""
    out, i, n = [], 0, len(data)
    while True:
        while data[i : i + 1] == b"\n" or data[i : i + 2] == b"\r\n":
            i += 1 if data[i : i + 1] == b"\n" else 2
        if i >= n:
            return out
        record, go = [], True
        while go:
            value = b""
            if data[i : i + 1] == b'"':
                i += 1
                while True:
                    if i >= n:
                        raise Malformed("unterminated")
                    if data[i : i + 2] == b'""':
                        value, i = value + b'"', i + 2
                    elif data[i : i + 1] == b'"':
                        i += 1
                        break
                    else:
                        value, i = value + data[i : i + 1], i + 1
                if i < n and data[i] != mark and data[i : i + 1] != b"\n" and data[i : i + 2] != b"\r\n":
                    raise Malformed("after_quote")
            else:
                while i < n and data[i] != mark and data[i : i + 1] != b"\n" and data[i : i + 2] != b"\r\n":
                    value, i = value + data[i : i + 1], i + 1
            record.append(value)
            if i < n and data[i] == mark:
                i += 1
            else:
                go = False
                i += 2 if data[i : i + 2] == b"\r\n" else 1
        out.append(record)


def outcome(f):
    try:
        return f()
    except Malformed as e:
        return e.args[0]


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet='a,"\r\n;x', max_size=24))
def test_same_as_slow_reading(text):
    data = text.encode()
    assert outcome(lambda: list(records(data, ord(",")))) == outcome(lambda: slow(data, ord(",")))


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"a,b\n1,2", [[b"a", b"b"], [b"1", b"2"]]),
        (b",x,\n", [[b"", b"x", b""]]),
        (b"a\r\n\r\nb\r\n", [[b"a"], [b"b"]]),
        (b" \n", [[b" "]]),
        (b"a\rb\n", [[b"a\rb"]]),
        (b"a\r", [[b"a\r"]]),
        (b'""\n', [[b""]]),
        (b'x"y"\n', [[b'x"y"']]),
        (b'"a,\n""b"\r\nc', [[b'a,\n"b'], [b"c"]]),
        (b"a,", [[b"a", b""]]),
        (b"\r", [[b"\r"]]),
    ],
)
def test_records(data, want):
    assert list(records(data, ord(","))) == want


@pytest.mark.parametrize(("data", "code"), [(b'"x', "unterminated"), (b'"x"y', "after_quote"), (b'"x"\r', "after_quote"), (b"", "no_header"), (b"\n\r\n", "no_header"), (b"a,b\n1\n", "ragged"), (b"a\n1,2\n", "ragged")])
def test_malformed(data, code):
    with pytest.raises(Malformed) as e:
        table(data, ord(","))
    assert e.value.args[0] == code


def test_delimiters():
    assert delimiter_byte(";") == 59 and delimiter_byte("\0") == 0
    for bad in (",,", "", "é", '"', "\r", "\n"):
        with pytest.raises(ValueError):
            delimiter_byte(bad)
    with pytest.raises(TypeError):
        delimiter_byte(b",")


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet='a,"\r\n', max_size=24))
def test_lines_scanned_apart(text):
    """For input within the grammar, following `ends_open` line by line cuts it into the same records."""
    data = text.encode()
    want = outcome(lambda: slow(data, ord(",")))
    inside, pending, got = False, b"", []
    lines = data.split(b"\n")
    for i, line in enumerate(lines):
        inside = ends_open(inside, line, ord(","))
        pending += line + (b"\n" if i + 1 < len(lines) else b"")
        if not inside:
            got.append(pending)
            pending = b""
    if isinstance(want, list):
        assert not inside and [r for part in got for r in records(part, ord(","))] == want

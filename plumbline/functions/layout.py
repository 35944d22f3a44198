"""Plain-text tables for people."""

from __future__ import annotations

from collections.abc import Sequence

#: Characters that would break a line or a column, as they are shown.
_SHOWN = str.maketrans({"\n": r"\n", "\r": r"\r", "\t": r"\t"})


def cell(value: int | float | str) -> str:
    """A value on one line."""
    return value.translate(_SHOWN) if isinstance(value, str) else repr(value)


def aligned(columns: Sequence[Sequence[str]], left: int = 0) -> list[str]:
    """Lines of columns of equal length, each as wide as its widest text; the first `left` columns start at the left, the others
    end at the right."""
    padded = []
    for k, texts in enumerate(columns):
        form = f"{{:{'<' if k < left else '>'}{max(map(len, texts), default=0)}}}"
        padded.append([form.format(text) for text in texts])
    return ["  ".join(line) for line in zip(*padded, strict=True)]

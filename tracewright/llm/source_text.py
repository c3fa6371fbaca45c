"""What source files share: their opening comment, their names, their batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

from ..functions.headers import LICENSE_NAMES as LICENSE_FILE_NAMES  # noqa: F401

_BLANK = b" \t\r\n\f\v"
_BOM = b"\xef\xbb\xbf"
_LINE_COMMENT = {"py": b"#", "sh": b"#", "pl": b"#", "rb": b"#", "f90": b"!", "f95": b"!", "f03": b"!", "f08": b"!", "f": b"!", "for": b"!"}


def suffix(relpath: str) -> str:
    """Lower-case text behind the last dot of the file name, '' if there is none."""
    name = relpath.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def opening_comment(data: bytes, suffix_: str) -> tuple[bytes, int]:
    """The comment that a file begins with, and where the rest of the file begins.

    A byte-order mark, blank lines and a ``#!`` line may come first. The comment is one ``/* */``
    block or an unbroken run of line comments of the file's language; an unclosed block is none.
    Files without one give ``(b"", n)`` with n behind what was skipped.
    """
    i, n = (3 if data.startswith(_BOM) else 0), len(data)

    def skip(at: int) -> int:
        while at < n and data[at] in _BLANK:
            at += 1
        return at

    i = skip(i)
    if data.startswith(b"#!", i):
        end = data.find(b"\n", i)
        i = skip(n if end < 0 else end + 1)
    if data.startswith(b"/*", i):
        end = data.find(b"*/", i + 2)
        return (b"", i) if end < 0 else (data[i : end + 2], end + 2)
    mark = _LINE_COMMENT.get(suffix_, b"//")
    if not data.startswith(mark, i):
        return b"", i
    at = i
    while at < n:
        line = at
        while line < n and data[line] in b" \t":
            line += 1
        if not data.startswith(mark, line):
            break
        end = data.find(b"\n", line)
        cr = data.find(b"\r", line, n if end < 0 else end)
        if cr >= 0 and cr + 1 < n and data[cr + 1 : cr + 2] != b"\n":
            end = cr  # old Mac line ends
        at = n if end < 0 else end + 1
    return data[i:at], at


_COMMENT_MARKS = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*|//+|!+|#+)?[ \t]?|\*/\s*$", re.M)


def comment_text(comment: bytes) -> str:
    """The words of a comment: bad bytes replaced, line ends unified, comment marks taken off."""
    text = comment.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return _COMMENT_MARKS.sub("", text)


def batches(rows: Iterable[bytes], limit: int = 150_000) -> Iterator[list[bytes]]:
    """Successive texts in lists of about ``limit`` bytes, as suits the processor's cache."""
    held, size = [], 0
    for data in rows:
        held.append(data)
        size += len(data)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A binary or string column as bytes; null gives b""."""
    column = batch.column(name)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [v or b"" for v in column.to_pylist()]

"""The values of JSON files as rows, from a stream: an array's elements one by one, a file's lines, or one value over many lines.

A tokenizer that keeps only its depth finds where an element ends, so a task holds one element and one chunk however large the array.
An element or line of more than ``VALUE_BYTES`` is passed over and gives a row with an error instead. Where an array breaks,
what follows is taken as lines. Blank lines give no row; numbering goes on over rows with errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .files import _open, tasks

VALUE_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
#: A whole string, a bracket or a comma; a lone quote is a string that goes on past the buffer.
TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|["\[\]{},]', re.S)
STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)
SOLID = re.compile(rb"[^ \t\r\n]")
BLANK = b" \t\r\n"
Value = tuple[bytes | None, str | None]


class Stream:
    """A buffer over a reader; what lies before ``at`` has been used and is dropped when more is read."""

    def __init__(self, read: Callable[[int], bytes]) -> None:
        self.read, self.data, self.at, self.ended = read, b"", 0, False

    def more(self) -> bool:
        """Reads on; the buffer then begins at what was ``at``."""
        found = b"" if self.ended else self.read(CHUNK_BYTES)
        self.ended = not found
        self.data, self.at = self.data[self.at :] + found, 0
        return not self.ended

    def next(self) -> bytes:
        """The next character that is not blank; nothing at the end."""
        while True:
            if m := SOLID.search(self.data, self.at):
                self.at = m.start()
                return m[0]
            self.at = len(self.data)
            if not self.more():
                return b""

    def left(self) -> int:
        return len(self.data) - self.at


def _too_long(most: int) -> Value:
    return None, f"a value of more than {most} bytes"


def _bracketed(s: Stream, most: int) -> tuple[Value, bool]:
    """The value in brackets that begins at the buffer's place, which goes past it; False if it never ends, and then the place stays."""
    seen = depth = 0  # bytes of the value that have been looked through
    lost = False
    while True:
        base = s.at
        for m in TOKEN.finditer(s.data, base + seen):
            token = m[0]
            if token == b'"':
                break
            seen = m.end() - base
            if token in (b"[", b"{"):
                depth += 1
            elif token in (b"]", b"}"):
                depth -= 1
                if not depth:
                    value = None if lost or seen > most else s.data[base : base + seen]
                    s.at = base + seen
                    return ((value, None) if value is not None else _too_long(most)), True
        # what is left of the buffer has no token, or ends inside a string
        q = s.data.find(b'"', base + seen)
        seen = s.left() if q < 0 else q - base
        lost = lost or s.left() > most
        if lost:
            s.at, seen = base + seen, 0
            if s.left() > most:  # inside a long string
                s.at += 1
                while not (m := STRING_END.match(s.data, s.at)):
                    rest = s.data[s.at :]
                    s.at = len(s.data) - (len(rest) - len(rest.rstrip(b"\\"))) % 2  # an odd backslash waits for what it escapes
                    if not s.more():
                        return _too_long(most), False
                s.at = m.end()
                continue
        if not s.more():
            return (_too_long(most) if lost else (None, None)), False


def _scalar(s: Stream, most: int) -> tuple[Value, bool]:
    """A string, number or word up to a comma or the array's end; False if neither comes, and then the place stays."""
    while True:
        for m in TOKEN.finditer(s.data, s.at):
            if m[0] in (b",", b"]"):
                value = s.data[s.at : m.start()].rstrip(BLANK)
                if value:
                    s.at = m.start()
                return (value, None), bool(value)
            if m[0] == b'"':
                break
        if s.left() > most:  # a string this long is passed over as one in brackets would be
            s.data, s.at = b"[" + s.data[s.at :], 0
            return _bracketed(s, most)[0], False
        if not s.more():
            return (None, None), False


def lines(s: Stream, most: int) -> Iterator[Value]:
    lost = False
    while True:
        end = s.data.find(b"\n", s.at)
        if end < 0:
            if s.left() > most:
                lost, s.at = True, len(s.data)
            if s.more():
                continue
            end = len(s.data)
        line = s.data[s.at : end].strip(BLANK)
        if lost or len(line) > most:
            yield _too_long(most)
            lost = False
        elif line:
            yield line, None
        s.at = min(end + 1, len(s.data))
        if s.ended and not s.left():
            return


def elements(s: Stream, most: int) -> Iterator[Value]:
    """The elements of the array that begins at the buffer's place; where it breaks, the rest as lines."""
    s.at += 1
    while (c := s.next()) and c != b"]":
        value, good = _bracketed(s, most) if c in b"{[" else _scalar(s, most)
        if good or value[0] is None and value[1]:
            yield value
        if good and (c := s.next()) == b",":
            s.at += 1
            continue
        if not good or c and c != b"]":
            yield from lines(s, most)
        return


def values(read: Callable[[int], bytes], most: int = VALUE_BYTES) -> Iterator[Value]:
    """(value, error) of a file's bytes."""
    s = Stream(read)
    while s.left() < 3 and s.more():
        pass
    if s.data.startswith(b"\xef\xbb\xbf"):
        s.at = 3
    first = s.next()
    if not first:
        return
    if first == b"[":
        yield from elements(s, most)
        return
    while s.data.find(b"\n", s.at) < 0 and s.left() <= most and s.more():
        pass
    try:
        json.loads(s.data[s.at :].split(b"\n", 1)[0])
        by_line = True
    except ValueError:
        by_line = first != b"{"
    if not by_line:
        value, good = _bracketed(s, most)
        if good or value[1]:
            yield value
            return
    yield from lines(s, most)


def json_values(paths: DataFrame, rows_most: int | None = None, value_bytes: int = VALUE_BYTES) -> DataFrame:
    """(file, line_no, line, error) of the values of each file in ``paths`` (file), the first ``rows_most`` of each; compression by suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            files, places, texts, errors = (list(c) for c in zip(*held, strict=True)) if held else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file", "line_no", "line", "error"])

        size = 0
        for given in batches:
            for path in given.column("file").to_pylist():
                n = 0
                try:
                    store, name = _open(path)
                    with store.open_input_stream(name) as f:
                        for n, (value, error) in enumerate(values(f.read, value_bytes), 1):
                            held.append((path, n, None if value is None else value.decode("utf-8", "replace"), error))
                            size += 100 + len(value or b"")
                            if size >= BATCH_BYTES:
                                yield batch()
                                held, size = [], 0
                            if n == rows_most:
                                break
                except OSError as e:
                    held.append((path, n + 1, None, str(e)))
        yield batch()

    return tasks(paths.select("file"), "file").mapInArrow(run, "file string, line_no long, line string, error string")

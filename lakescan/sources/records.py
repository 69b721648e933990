"""Records of delimited text whose quoted cells may hold line ends, without one task for a file.

Whether a line end closes a record depends on all quotes before it. An automaton of four states (at a cell's start, inside a plain
cell, inside quotes, after a quote inside quotes) reads bytes; for a byte range it is a map from the state at its start
to the state at its end. Every range of every file is mapped on its own, the maps are composed file by file over a
few numbers a range, and then each range knows its state and cuts its own records. A record belongs to the range that holds
the line end before it; the range reads on until the record is whole.

Quotes are doubled inside quotes; a quote inside a plain cell is a character like others. Compressed files are one range each, read
as a stream. A record of more than ``RECORD_BYTES``, as a quote that is never closed makes it, ends the read with an error that
names file and place, rather than losing rows silently.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import COMPRESSED, _open, tasks

RANGE_BYTES = 8 << 20
RECORD_BYTES = 64 << 20
START, PLAIN, QUOTED, ENDED = range(4)
QUOTE, LINE_END = b'"'[0], b"\n"[0]


def advance(data: bytes, state: int, seps: bytes) -> tuple[int, int, bool]:
    """(state at the end, place after the first line end outside quotes or -1, whether quotes hold a line end)."""
    at, n, first, held = 0, len(data), -1, False
    opens = (*seps, LINE_END)
    while at < n:
        if state == ENDED:
            doubled = data[at] == QUOTE
            at, state = at + doubled, QUOTED if doubled else PLAIN
        elif state == QUOTED:
            q = data.find(b'"', at)
            held = held or data.find(b"\n", at, n if q < 0 else q) >= 0
            at, state = (n, QUOTED) if q < 0 else (q + 1, ENDED)
        else:
            q = data.find(b'"', at)
            upto = n if q < 0 else q
            if first < 0 and (end := data.find(b"\n", at, upto)) >= 0:
                first = end + 1
            begins = state == START if upto == at else data[upto - 1] in opens
            if q < 0:
                return START if begins else PLAIN, first, held
            at, state = q + 1, QUOTED if begins else PLAIN
    return state, first, held


def range_map(data: bytes, seps: bytes) -> list[tuple[int, int, bool]]:
    """What ``advance`` gives from each of the four states; two runs unless a quote comes first."""
    start, quoted = advance(data, START, seps), advance(data, QUOTED, seps)
    if data[:1] == b'"':
        return [start, advance(data, PLAIN, seps), quoted, advance(data, ENDED, seps)]
    return [start, start, quoted, start] if data else [(s, -1, False) for s in range(4)]


def cut(data: bytes, at: int, seps: bytes) -> tuple[list[tuple[int, int]], int]:
    """The records (start, end without line end) from a record's start on that end in ``data``, and where the rest begins."""
    out, n, begin = [], len(data), at
    opens = (*seps, LINE_END)
    if data.find(b'"', at) < 0:
        while (end := data.find(b"\n", begin)) >= 0:
            out.append((begin, end))
            begin = end + 1
        return out, begin
    state = START
    while at < n:
        if state == ENDED:
            doubled = data[at] == QUOTE
            at, state = at + doubled, QUOTED if doubled else PLAIN
        elif state == QUOTED:
            q = data.find(b'"', at)
            at, state = (n, QUOTED) if q < 0 else (q + 1, ENDED)
        else:
            end = data.find(b"\n", at)
            q = data.find(b'"', at, n if end < 0 else end)
            if q < 0:
                if end < 0:
                    break
                out.append((begin, end))
                begin = at = end + 1
                state = START
            else:
                begins = state == START if q == at else data[q - 1] in opens
                at, state = q + 1, QUOTED if begins else PLAIN
    return out, begin


def whole_records(data: bytes, seps: bytes) -> tuple[list[bytes], bool]:
    """The records of a text's beginning, and whether the last one may be cut off."""
    spans, rest = cut(data, 0, seps)
    out = [data[a:b] for a, b in spans]
    return (out + [data[rest:]], True) if rest < len(data) else (out, False)


def _ranges(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sep in zip(batch.column("file").to_pylist(), batch.column("sep").to_pylist(), strict=True):
                store, name = _open(path)
                size = store.get_file_info(name).size
                starts = [0] if name.endswith(COMPRESSED) else list(range(0, size, range_bytes))
                ends = [None] if name.endswith(COMPRESSED) else [min(s + range_bytes, size) for s in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([sep] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["file", "sep", "no", "start", "end"])

    return run


RANGES = "file string, sep string, no long, start long, end long"
MAPPED = RANGES + ", states array<int>, held array<boolean>"
FOLDED = RANGES + ", state int, held boolean"


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states, held = [], []
        for r in batch.to_pylist():
            store, name = _open(r["file"])
            seps = r["sep"].encode()
            if r["end"] is None:
                state, any_ = START, False
                with store.open_input_stream(name) as f:
                    while data := f.read(RANGE_BYTES):
                        state, _, more = advance(data, state, seps)
                        any_ = any_ or more
                found = [(state, -1, any_)] * 4
            else:
                with store.open_input_file(name) as f:
                    f.seek(r["start"])
                    found = range_map(f.read(r["end"] - r["start"]), seps)
            states.append([x[0] for x in found])
            held.append([x[2] for x in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.bool_()))], names=[*batch.schema.names, "states", "held"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole files in order -> the state that each begins in."""
    state = START
    for batch in batches:
        at, held = [], []
        for no, states, flags in zip(*(batch.column(c).to_pylist() for c in ("no", "states", "held")), strict=True):
            state = START if no == 0 else state
            at.append(state)
            held.append(flags[state])
            state = states[state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at, pa.int32()), pa.array(held, pa.bool_())], names=[*batch.schema.names[:5], "state", "held"])


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, sep, no, start, end, state, held): the byte ranges of ``files`` (file, sep), the state each begins in, and whether its quotes hold a line end."""
    cut_ = tasks(files.select("file", "sep"), "file").mapInArrow(_ranges(range_bytes), RANGES)
    mapped = tasks(cut_, "file", "no").mapInArrow(_mapped, MAPPED)
    return mapped.repartition("file").sortWithinPartitions("file", "no").mapInArrow(_folded, FOLDED)


def _cut_range(r: dict, record_bytes: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Portions (places, records) of a range."""
    store, name = _open(r["file"])
    seps, whole = r["sep"].encode(), r["end"] is None
    with store.open_input_stream(name) if whole else store.open_input_file(name) as f:
        if whole:
            data, base, end = f.read(RANGE_BYTES), 0, None
        else:
            f.seek(r["start"])
            data, base, end = f.read(r["end"] - r["start"]), r["start"], r["end"]
        at = 0
        if r["no"]:
            at = advance(data, r["state"], seps)[1]
            if at < 0:
                return
        while True:
            spans, rest = cut(data, at, seps)
            if end is not None:
                spans = [s for s in spans if base + s[0] <= end]
            if spans:
                yield [base + a for a, _ in spans], [data[a:b] for a, b in spans]
            if end is not None and base + rest > end:
                return
            if len(data) - rest > record_bytes:
                raise ValueError(f"{r['file']}: the record at byte {base + rest} has more than {record_bytes} bytes; a quote may not be closed")
            more = f.read(max(RANGE_BYTES // 8, len(data) - rest) if end is not None else RANGE_BYTES)
            if not more:
                if rest < len(data):
                    yield [base + rest], [data[rest:]]
                return
            data, base, at = data[rest:] + more, base + rest, 0


def _records(record_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first = r["no"] == 0
                for places, found in _cut_range(r, record_bytes):
                    if places and places[0] == 0:
                        found[0] = found[0].removeprefix(b"\xef\xbb\xbf")
                    both = [(p, x) for p, x in zip(places, (x.removesuffix(b"\r") for x in found), strict=True) if x]
                    flags = [first and k == 0 for k in range(len(both))]
                    first = first and not both
                    texts = [x.decode("utf-8", "replace") for _, x in both]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(both), pa.string()), pa.array([p for p, _ in both], pa.int64()), pa.array(texts, pa.string()), pa.array(flags, pa.bool_())], names=["file", "at", "record", "first"])

    return run


def records(found: DataFrame, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(file, at, record, first): the records that are not blank of ``ranges``, their byte place (in the decoded text of compressed files), and whether one is its file's first."""
    return tasks(found, "file", "no").mapInArrow(_records(record_bytes), "file string, at long, record string, first boolean")


def quoted_line_ends(found: DataFrame) -> DataFrame:
    """(file) of the files that have a line end inside quotes."""
    return found.where("held").select("file").distinct()

"""Bounded reads of many files in one job: text heads (E8), Parquet and ORC footers, Avro headers (E13-E15), other schemas.

Paths are a table, so executors share the work; each task opens files through ``pyarrow.fs`` and reads a bounded part.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 262_144
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4")
SEPARATORS = b",;|\t"
LINE = "file string, line_no long, line string"
FOOTER = "file string, pos int, name string, type string, nullable boolean, num_rows long, codec string, error string"
FOOTER_NAMES = [c.split()[0] for c in FOOTER.split(", ")]


def _open(path: str):
    """The store and the name in it; local paths may be plain, as Spark lists them, or escaped, as ``_metadata`` has them."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        name = "/" + path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), name if os.path.exists(name) else unquote(name)
    return fs.FileSystem.from_uri(quote(path, safe="/:@%?=&+,;!$'()*~"))


def tasks(d: DataFrame, *keys: str) -> DataFrame:
    """Rows that each stand for much work, over as many tasks as shuffles have: adaptive execution would put such small rows into one."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def heads(paths: DataFrame, head_bytes: int = HEAD_BYTES, partitions: int | None = None, quoted: bool = False) -> DataFrame:
    """(file, line_no, line) of the first bytes of each file in ``paths`` (file); gzip, bz2, zstd and lz4 by suffix, four times the bytes then. Files that cannot be opened or unpacked have none. With ``quoted`` lines are records, whose quotes may hold line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                try:
                    store, name = _open(path)
                    with store.open_input_stream(name) as f:  # a known compression suffix is decoded
                        most = head_bytes * (4 if name.endswith(COMPRESSED) else 1)
                        data = f.read(most)
                except OSError:  # a file that is gone or does not unpack has no lines
                    continue
                whole = len(data) < most
                if quoted:
                    from .records import whole_records

                    found, open_ = whole_records(data.removeprefix(b"\xef\xbb\xbf"), SEPARATORS)
                    lines = [x.decode("utf-8", "replace") for x in (found[:-1] if open_ and not whole else found)]
                else:
                    lines = data.decode("utf-8", "replace").removeprefix("\ufeff").split("\n")
                    lines = lines[: None if whole and lines[-1] else -1]  # a line cut at the end is not one
                lines = [x.removesuffix("\r") for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], names=["file", "line_no", "line"])

    d = paths.select("file")
    return (d.repartition(partitions) if partitions else tasks(d, "file")).mapInArrow(run, LINE)


def _columns_of(paths: DataFrame, read: Callable) -> DataFrame:
    """FOOTER rows of each file by ``read(store, name)``, which gives ([(name, type, nullable)], rows, codec); a file that cannot be read gives one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column("file").to_pylist():
                try:
                    found, rows, codec = read(*_open(path))
                    out = [(path, i, *x, rows, codec, None) for i, x in enumerate(found)]
                except Exception as e:  # whatever the file does to its reader, the others go on
                    out = [(path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                columns = list(zip(*out, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=FOOTER_NAMES)

    return tasks(paths.select("file"), "file").mapInArrow(run, FOOTER)


def footers(paths: DataFrame) -> DataFrame:
    """FOOTER rows from Parquet footers alone; types are Spark's."""

    def read(store, name):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_type

        with store.open_input_file(name) as f:
            meta = pq.read_metadata(f)
        codec = meta.row_group(0).column(0).compression.lower() if meta.num_row_groups and meta.num_columns else "none"
        return [(x.name, from_arrow_type(x.type, prefer_timestamp_ntz=True).simpleString(), x.nullable) for x in meta.schema.to_arrow_schema()], meta.num_rows, codec

    return _columns_of(paths, read)


def described(spark: SparkSession, df: DataFrame, file: str = "") -> DataFrame:
    """A source's columns (file, pos, name, type, nullable), without scanning rows."""
    rows = [(file, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "file string, pos int, name string, type string, nullable boolean")


def orc_footers(paths: DataFrame) -> DataFrame:
    """FOOTER rows from ORC footers alone, any codec; ORC columns may all be null."""

    def read(store, name):
        from pyarrow import orc
        from pyspark.sql.pandas.types import from_arrow_type

        with store.open_input_file(name) as f:
            found = orc.ORCFile(f)
            codec = str(found.compression).lower()
            return [(x.name, from_arrow_type(x.type, prefer_timestamp_ntz=True).simpleString(), True) for x in found.schema], found.nrows, "none" if codec == "uncompressed" else codec

    return _columns_of(paths, read)


def avro_headers(paths: DataFrame) -> DataFrame:
    """FOOTER rows from Avro headers alone, without the number of rows."""

    def read(store, name):
        from .avro_header import columns

        with store.open_input_file(name) as f:
            found, codec = columns(f)
        return found, None, codec

    return _columns_of(paths, read)


CELL = "file string, line_no long, pos int, name string, value string"


def first_rows(paths: DataFrame, fmt: str, rows: int = 1000) -> DataFrame:
    """(file, line_no, pos, name, value) of the first rows of Parquet or ORC files, cells as text; nested cells as JSON.

    Of Parquet files the first row group is read in batches, of ORC files the first stripe. Files that cannot be read have no rows.
    """

    def table(store, name) -> pa.Table:
        with store.open_input_file(name) as f:
            if fmt == "parquet":
                import pyarrow.parquet as pq

                found = pq.ParquetFile(f, pre_buffer=False)
                batch = next(found.iter_batches(rows, row_groups=[0]), None) if found.metadata.num_row_groups else None
                return pa.Table.from_batches([batch] if batch is not None else [], found.schema_arrow)
            from pyarrow import orc

            found = orc.ORCFile(f)
            return pa.Table.from_batches([found.read_stripe(0)] if found.nstripes else [], found.schema).slice(0, rows)

    def texts(column: pa.ChunkedArray) -> list:
        kind = column.type
        if pa.types.is_nested(kind):
            return [None if x is None else json.dumps(x, default=str) for x in column.to_pylist()]
        if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) or pa.types.is_fixed_size_binary(kind):
            return [None if x is None else x.hex().upper() for x in column.to_pylist()]
        try:
            return column.cast(pa.string()).to_pylist()
        except pa.ArrowException:
            return [None if x is None else str(x) for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                try:
                    found = table(*_open(path))
                except Exception:  # as the footers' jobs tell
                    continue
                for i, name in enumerate(found.column_names):
                    n = found.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(1, n + 1), pa.int64()), pa.array([i] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(texts(found.column(i)), pa.string())], names=["file", "line_no", "pos", "name", "value"])

    return tasks(paths.select("file"), "file").mapInArrow(run, CELL)

"""Schema inference from text and JSON, over many files in one job.

Input is a table of lines (file, line_no, line), which ``sources.heads`` makes; every step is an aggregate by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import BITS, cell_bit, cell_type, is_null_text, merged_type, stripped, type_bit

DELIMITERS = ["|", "\t", ";"]
NUMERIC = ["integer", "float", "decimal"]


def _sniffed(lines: DataFrame, delimiter: str = "") -> DataFrame:
    """``lines`` with their place in the file (_row), whether they are its first (_top), the first one's text (top) and the delimiter (E5), a given one or that of the first 40 lines that are not blank.

    All windows share one sort of a file's lines, and a file's delimiter is found at its first line.
    """
    file = Window.partitionBy("file")
    so_far = file.orderBy("line_no", "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumns({"_row": F.row_number().over(file.orderBy("line_no", "line")), "_top": F.col("line_no") == F.first("line_no").over(so_far), "top": F.first("line").over(so_far)})
    if delimiter:
        return d.withColumn("delimiter", F.lit(delimiter))
    text = stripped(F.col("line")) != ""
    d = d.withColumn("_sniffed", text & (F.count_if(text).over(so_far) <= 40))
    for i, x in enumerate(DELIMITERS):
        d = d.withColumn(f"_{i}", F.when(F.col("_sniffed"), F.length("line") - F.length(F.replace("line", F.lit(x), F.lit(""))) + 1))
    d = d.withColumns({f"_fields{i}": F.collect_list(f"_{i}").over(file) for i in range(len(DELIMITERS))})  # 40 numbers at most

    def good(i: int) -> Column:
        counts = F.col(f"_fields{i}")
        most = F.array_max(F.transform(F.array_distinct(counts), lambda x: F.struct(F.size(F.filter(counts, lambda y: y == x)).alias("n"), x.alias("fields"))))
        return (F.size(counts) >= 2) & (most["fields"] >= 2) & (10 * most["n"] >= 8 * F.size(counts))

    found = F.coalesce(*[F.when(good(i), F.lit(x)) for i, x in enumerate(DELIMITERS)], F.lit(","))
    d = d.withColumn("_found", F.when(F.col("_row") == 1, found)).select(*lines.columns, "_row", "_top", "top", "_found")
    return d.withColumn("delimiter", F.first("_found").over(so_far)).drop("_found")


def sniff_delimiters(lines: DataFrame) -> DataFrame:
    """E5: (file, delimiter): of the first 40 non-blank lines, 80 % with the same number of fields, two at least; else a comma."""
    return _sniffed(lines.select("file", "line_no", "line")).where("_row = 1").select("file", "delimiter")


def _cells(line: Column, delimiter: Column) -> Column:
    """The cells of a line; quoted fields may hold the delimiter, doubled quotes stand for one."""
    quoted = F.regexp_extract_all(line, F.concat(F.lit(r'(?:^|\Q'), delimiter, F.lit(r'\E)("(?:[^"]|"")*"|[^\Q'), delimiter, F.lit(r'\E]*)')), F.lit(1))
    escaped = F.when(delimiter.isin([*DELIMITERS, ","]), F.concat(F.lit("\\"), delimiter)).otherwise(F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")))  # one escaped sign is split without a pattern
    plain = F.split(line, escaped)
    clean = lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.when(line.contains('"'), F.transform(quoted, clean)).otherwise(plain)


def split_cells(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """(file, line_no, pos, value): the cells of each line; quoted fields may hold the delimiter, doubled quotes stand for one."""
    return lines.where("line <> ''").join(delimiters, "file").select("file", "line_no", F.posexplode(_cells(F.col("line"), F.col("delimiter"))).alias("pos", "value"))


def _firsts(cells: DataFrame) -> DataFrame:
    """(file, first, has_header): the first row's number and E6, from the least and greatest row of each file and of its numbers."""
    number = F.when(cell_type(F.col("value")).isin(NUMERIC), F.col("line_no"))
    g = cells.groupBy("file").agg(F.min("line_no").alias("first"), F.max("line_no").alias("_last"), F.min(number).alias("_low"), F.max(number).alias("_high"))
    first = F.col("first")
    return g.select("file", "first", (F.coalesce(F.col("_low") > first, F.lit(True)) & (F.coalesce(F.col("_high") > first, F.lit(False)) | (F.col("_last") == first))).alias("has_header"))


def detect_headers(cells: DataFrame) -> DataFrame:
    """(file, has_header): no number in the first row, and one in a later row or no later row."""
    return _firsts(cells).select("file", "has_header")


def _named(columns: DataFrame) -> DataFrame:
    """``columns`` (file, pos, has_header, _name) with E7's name."""
    d = columns.withColumn("_name", F.when(F.col("has_header") & (F.coalesce("_name", F.lit("")) != ""), F.col("_name")).otherwise(F.concat(F.lit("col_"), F.col("pos") + 1)))
    n = F.row_number().over(Window.partitionBy("file", "_name").orderBy("pos"))
    return d.withColumn("_n", n).withColumn("name", F.when(F.col("_n") > 1, F.concat_ws("_", "_name", "_n")).otherwise(F.col("_name"))).drop("_n", "_name")


def header_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, pos, name): trimmed header cells; blank or missing ones are ``col_i``, repeats get ``_2``, ``_3``. Cells are hashed, not sorted: a task holds a row a file and column."""
    first = cells.groupBy("file").agg(F.min("line_no").alias("_first"))
    top = cells.join(first.hint("shuffle_hash"), "file").where("line_no <= _first").select("file", "pos", stripped(F.col("value")).alias("_name"))
    d = cells.select("file", "pos").distinct().join(top, ["file", "pos"], "left").join(headers, "file")
    return _named(d).select("file", "pos", "name")


def infer_text(lines: DataFrame, rows_most: int = 1000, delimiter: str = "") -> DataFrame:
    """(file, pos, name, type, nullable, delimiter, has_header) for every delimited file of ``lines``. Ragged rows miss cells, which makes those columns nullable. A format's own ``delimiter`` is not sniffed.

    Lines are shuffled and sorted once, by file; each cell's kind is found once and goes into one hashed row a column, with the
    first row's kinds apart, as only the whole file tells whether that row is a header.
    """
    d = lines.where(F.col("line_no") <= rows_most + 1).where("line <> '' AND file IS NOT NULL").select("file", "line_no", "line")
    cells = _sniffed(d, delimiter).select("file", "delimiter", "top", "_top", F.posexplode(_cells(F.col("line"), F.col("delimiter"))).alias("pos", "value"))
    cells = cells.withColumn("_bit", cell_bit(F.col("value"))).withColumn("_null", F.col("_bit") == 0)
    amounts = []
    for part, own in (("top", F.col("_top")), ("rest", ~F.col("_top"))):
        amounts += [F.bit_or(F.when(own, F.col("_bit"))).alias(f"_{part}_bits"), F.count_if(own & F.col("_null")).alias(f"_{part}_nulls"), F.count_if(own).alias(f"_{part}_cells")]
    c = cells.groupBy("file", "delimiter", "top", "pos").agg(*amounts)
    w, numbers = Window.partitionBy("file"), sum(BITS[k] for k in NUMERIC)
    number = lambda part: F.max(F.coalesce(F.col(f"_{part}_bits"), F.lit(0)).bitwiseAND(numbers) != 0).over(w)
    c = c.withColumn("has_header", ~number("top") & (number("rest") | ~F.max(F.col("_rest_cells") > 0).over(w)))
    body = lambda name: F.coalesce(F.col(f"_rest_{name}"), F.lit(0)) + F.when(F.col("has_header"), 0).otherwise(F.col(f"_top_{name}"))
    bits = F.coalesce("_rest_bits", F.lit(0)).bitwiseOR(F.when(F.col("has_header"), 0).otherwise(F.coalesce("_top_bits", F.lit(0))))
    c = c.withColumns({"_bits": bits, "_nulls": body("nulls"), "_own": body("cells"), "_name": F.when(F.col("has_header"), stripped(F.get(_cells(F.col("top"), F.col("delimiter")), F.col("pos"))))})
    c = c.withColumn("_rows", F.max("_own").over(w))  # each row has a first cell
    kind = merged_type(F.col("_bits"))
    nullable = (F.col("_nulls") > 0) | (F.col("_bits") == 0) | (F.col("_own") < F.col("_rows"))
    return _named(c).select("file", "pos", "name", F.when(kind == "null", "string").otherwise(kind).alias("type"), nullable.alias("nullable"), "delimiter", "has_header")


def estimated_rows(sampled_bytes: Column, sampled_rows: Column, file_size: Column, compressed: Column) -> Column:
    """File size over mean row bytes, the sample's own rows for smaller files; null for compressed files."""
    mean = sampled_bytes / F.greatest(sampled_rows, F.lit(1))
    return F.when(compressed, F.lit(None).cast("long")).when(file_size <= sampled_bytes, sampled_rows).otherwise(F.floor(file_size / mean))


def json_kind(value: Column, text: Column) -> Column:
    """The kind of a variant: null, struct, array, boolean, integer, float; strings by their text."""
    s = F.schema_of_variant(value)
    return (
        F.when(s == "VOID", "null").when(s.startswith("OBJECT"), "struct").when(s.startswith("ARRAY"), "array").when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float").otherwise(cell_type(text))
    )


def infer_json(lines: DataFrame) -> DataFrame:
    """(file, pos, name, type, nullable) from JSON lines; bad lines are skipped, keys sorted, a key missing in a row makes it nullable."""
    d = lines.withColumn("_v", F.try_parse_json("line")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    rows = d.groupBy("file").agg(F.count("*").alias("_rows"))
    cells = d.lateralJoin(d.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("file", "line_no", F.col("key").alias("name"), "value", F.col("value").cast("string").alias("text"))
    cells = cells.withColumn("_kind", json_kind(F.col("value"), F.col("text")))
    g = cells.groupBy("file", "name").agg(F.bit_or(type_bit(F.col("_kind"))).alias("_bits"), F.max(F.col("_kind") == "null").alias("_null"), F.count("*").alias("_n")).join(rows, "file")
    t = merged_type(F.col("_bits"))
    pos = F.row_number().over(Window.partitionBy("file").orderBy("name")) - 1
    return g.select("file", pos.alias("pos"), "name", F.when(t == "null", "string").otherwise(t).alias("type"), (F.col("_null") | (F.col("_bits") == 0) | (F.col("_n") < F.col("_rows"))).alias("nullable"))


def json_lines(documents: DataFrame) -> DataFrame:
    """(file, line_no, line) of JSON files (file, content): an array's elements, a single object, or else the file's lines."""
    d = documents.withColumn("_v", F.try_parse_json("content"))
    kind = F.schema_of_variant("_v")
    arrays = d.where(kind.startswith("ARRAY"))
    arrays = arrays.lateralJoin(d.sparkSession.tvf.variant_explode(F.col("_v").outer())).select("file", (F.col("pos") + 1).cast("long").alias("line_no"), F.to_json("value").alias("line"))
    others = d.where(F.coalesce(~kind.startswith("ARRAY"), F.lit(True)))
    # the parser stops at the first value's end, so what has an object in its first line is read by lines
    first = F.get(F.filter(F.split("content", "\n"), lambda x: stripped(x) != ""), F.lit(0))
    by_line = F.coalesce(F.schema_of_variant(F.try_parse_json(first)).startswith("OBJECT"), F.lit(False))
    whole = F.when(kind.startswith("OBJECT") & ~by_line, F.array("content")).otherwise(F.split("content", "\n"))
    others = others.select("file", F.posexplode(whole).alias("pos", "line")).select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    return arrays.unionByName(others)


def sample_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Count, nulls, distinct, least and greatest text, completeness, uniqueness, and the first ten distinct values."""
    null = is_null_text(F.col("value"))
    g = cells.groupBy(*keys).agg(F.count("*").alias("count"), F.count_if(null).alias("null_count"), F.count_distinct(F.when(~null, F.col("value"))).alias("distinct_count"), F.min(F.when(~null, F.col("value"))).alias("min"), F.max(F.when(~null, F.col("value"))).alias("max"))
    seen = cells.where(~null).groupBy(*keys, "value").agg(F.min("line_no").alias("at"))
    first = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "value"))).where("_n <= 10").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("samples"))
    full = F.col("count") - F.col("null_count")
    return g.join(first, keys, "left").withColumns({"completeness": F.when(F.col("count") > 0, full / F.col("count")).otherwise(0.0), "uniqueness": F.when(full > 0, F.col("distinct_count") / full).otherwise(0.0)})


def sample_rows(cells: DataFrame, names: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """(keys, line_no, row): the first rows as JSON objects of column to text."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("line_no"))
    d = cells.withColumn("_n", rank).where(F.col("_n") <= most).join(names.select(*keys, "pos", "name"), [*keys, "pos"])
    return d.groupBy(*keys, "line_no").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "value"))), lambda x: F.struct(x["name"], x["value"])))).alias("row"))


def text_cells(lines: DataFrame, rows_most: int = 1000, delimiter: str = "") -> DataFrame:
    """(file, line_no, pos, name, value) of the rows of delimited files under their header's names."""
    d = lines.where(F.col("line_no") <= rows_most + 1)
    delimiters = d.select("file").distinct().withColumn("delimiter", F.lit(delimiter)) if delimiter else sniff_delimiters(d)
    cells = split_cells(d, delimiters)
    headers = _firsts(cells)
    body = cells.join(headers, "file").where("NOT (has_header AND line_no = first)")
    return body.join(header_names(cells, headers), ["file", "pos"]).select("file", "line_no", F.col("pos").cast("int").alias("pos"), "name", "value")


def json_cells(lines: DataFrame, rows_most: int = 1000) -> DataFrame:
    """(file, line_no, pos, name, value) of the objects of JSON lines; keys in order, JSON nulls null."""
    d = lines.where(F.col("line_no") <= rows_most).withColumn("_v", F.try_parse_json("line")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    d = d.lateralJoin(d.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL")
    nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    d = d.select("file", "line_no", F.col("key").alias("name"), F.when(nested, F.to_json("value")).otherwise(F.col("value").cast("string")).alias("value"))
    names = d.select("file", "name").distinct().withColumn("pos", (F.row_number().over(Window.partitionBy("file").orderBy("name")) - 1).cast("int"))
    return d.join(names, ["file", "name"]).select("file", "line_no", "pos", "name", "value")

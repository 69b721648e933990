"""Column profiles (H1-H8): scalars in one aggregate, top values and histograms by one unpivot each, badges, extended statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import checkpoint

#: How many top values and bins, up to how many columns, and the patterns of identifiers and mail addresses.
TOP_VALUES = 8
BINS = 12
WIDEST = 40
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def kind_of(dtype: T.DataType) -> str:
    """H1: numeric, string, temporal, bool or other; intervals are temporal, nested and binary columns other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "temporal"
    return "bool" if isinstance(dtype, T.BooleanType) else "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def _text(df: DataFrame, c: str) -> Column:
    """A cell as text: binary ones as hexadecimal digits, nested ones as JSON."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.BinaryType):
        return F.hex(_name(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.when(_name(c).isNotNull(), F.to_json(_name(c)))
    return _name(c).cast("string")


def _texts(df: DataFrame, names: list[str], as_text) -> DataFrame:
    """(column, value): every named column's cells, by one generator over the row."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("value")) for c in names])
    return df.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def sorted_run(df: DataFrame, names: list[str], pieces: int | None = None) -> DataFrame:
    """(column, value, number, n): each distinct value of the named columns, as text and, of numeric columns, as a number, and how often it occurs.

    Values are counted once, range-partitioned by column and number, and written in their partitions: distinct counts, entropy,
    top values and exact quantiles are all read from there. Ranges are cut by Spark's sample of the values, so partitions
    follow the number of values; there are as many as shuffles have, or ``pieces``.
    """
    ks = kinds(df)
    counts = _texts(df, names, lambda c: _text(df, c)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("column").isin([c for c in names if ks[c] == "numeric"]), F.col("value").try_cast("double"))
    return checkpoint(counts.select("column", "value", number.alias("number"), "n").repartitionByRange(*[pieces] * bool(pieces), "column", "number").sortWithinPartitions("column", "number"))


def exact_quantiles(df: DataFrame, names: list[str], at: list[float], pieces: int | None = None, run: DataFrame | None = None) -> DataFrame:
    """(column, q) from the columns' sorted run, or from one that is given: exact quantiles with linear interpolation, q having one value for each of ``at``.

    Running ranks come from the partitions' sums, so only the partitions that wanted ranks fall in are ranked value by value.
    """
    run = sorted_run(df, names, pieces) if run is None else run
    counts = run.where("number IS NOT NULL").select("column", F.col("number").alias("value"), "n", F.spark_partition_id().alias("piece"))
    by = Window.partitionBy("column")
    sums = counts.groupBy("column", "piece").agg(F.sum("n").alias("n"))  # a row a column and partition at most
    sums = sums.withColumns({"before": F.sum("n").over(by.orderBy("piece")) - F.col("n"), "total": F.sum("n").over(by)})
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.expr(f"{'floor' if side == 0 else 'ceil'}({q}D * (total - 1))").cast("long").alias("rank"), (F.lit(q) * (F.col("total") - 1)).alias("place")) for i, q in enumerate(at) for side in (0, 1)])
    wanted = sums.select("column", "piece", "before", "n", F.explode(ranks).alias("w")).where("w.rank >= before AND w.rank < before + n").select(F.col("column").alias("_c"), F.col("piece").alias("_p"), "before", "w.*")
    found = counts.join(F.broadcast(wanted), (F.col("column") == F.col("_c")) & (F.col("piece") == F.col("_p")))  # a few rows a column
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("column", "piece", "i", "side").orderBy("value"))
    found = found.withColumn("upto", upto).where("upto > rank").groupBy("column", "i", "side", "rank", "place").agg(F.min("value").alias("value"))
    low, high = F.max(F.when(F.col("side") == 0, F.col("value"))), F.max(F.when(F.col("side") == 1, F.col("value")))
    share = F.max(F.when(F.col("side") == 0, F.col("place") - F.col("rank")))
    each = found.groupBy("column", "i").agg((low + share * (high - low)).alias("value"))
    return each.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("q"))


def scalars(df: DataFrame, exact: bool = False) -> DataFrame:
    """H2, H5: one row a column: count, non_null, distinct, min and max as text, mean, stddev, median, lengths, null_pct, distinct_pct.

    All aggregates of all columns are one aggregate over one scan. ``exact`` counts distinct values exactly.
    """
    ks = kinds(df)
    num, text, null = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = []
    for c, k in ks.items():
        x = _name(c)
        ordered = k not in ("other",)
        d = null if exact else F.approx_count_distinct(x if ordered else F.xxhash64(F.to_json(F.struct(x))))
        v = x.cast("double")
        length = F.length(x.cast("string"))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count("*").alias("count"), F.count(x).alias("non_null"), d.alias("distinct"),
            (F.min(x).cast("string") if ordered else text).alias("min"), (F.max(x).cast("string") if ordered else text).alias("max"),
            (F.avg(v) if k == "numeric" else num).alias("mean"), (F.stddev_pop(v) if k == "numeric" else num).alias("stddev"), (F.percentile_approx(v, 0.5) if k == "numeric" and not exact else num).cast("double").alias("median"),
            (F.min(length).cast("long") if k == "string" else null).alias("min_length"), (F.max(length).cast("long") if k == "string" else null).alias("max_length"), (F.avg(length) if k == "string" else num).alias("avg_length"),
        ))
    out = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if exact:
        # distinct aggregates side by side would copy every row once a column; pairs of column and value are narrow
        run = sorted_run(df, list(ks))
        n = run.groupBy("column").agg(F.count("*").alias("_distinct"))
        out = out.join(F.broadcast(n), "column", "left").withColumn("distinct", F.coalesce("_distinct", F.lit(0))).drop("_distinct")  # a row a column
        if "numeric" in ks.values():
            out = out.join(F.broadcast(exact_quantiles(df, [], [0.5], run=run)), "column", "left").withColumn("median", F.get("q", F.lit(0))).drop("q")  # a row a column
    share = lambda a, b: F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(0.0)
    return out.withColumns({"null_pct": share(F.col("count") - F.col("non_null"), F.col("count")), "distinct_pct": share(F.col("distinct"), F.col("non_null"))})


def top_values(df: DataFrame, n: int = TOP_VALUES) -> DataFrame:
    """H3, H7: (column, place, value, n) of the most frequent values of non-numeric columns, ties by value; none for wide tables."""
    ks = kinds(df)
    names = [c for c, k in ks.items() if k != "numeric"] if len(df.columns) <= WIDEST else []
    if not names:
        return df.sparkSession.createDataFrame([], "column string, place int, value string, n long")
    counts = _texts(df, names, lambda c: _text(df, c)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= n).select("column", "place", "value", "n")


def histograms(df: DataFrame, bins: int = BINS) -> DataFrame:
    """H4, H7: (column, bin, low, high, n): equal widths from min to max of the finite values; max falls in the last bin. Columns with one value have none."""
    names = [c for c, k in kinds(df).items() if k == "numeric"] if len(df.columns) <= WIDEST else []
    if not names:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n long")
    v = _texts(df, names, lambda c: _name(c).cast("double")).where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    ends = v.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("k")).where("k >= 2 AND hi > lo").select(F.col("column").alias("_c"), "lo", "hi")
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = v.join(F.broadcast(ends), F.col("column") == F.col("_c")).groupBy("_c", at.alias("bin")).agg(F.count("*").alias("n"))  # a row a column
    every = ends.select("_c", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, ["_c", "bin"], "left").select(F.col("_c").alias("column"), "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def pattern_shares(df: DataFrame) -> DataFrame:
    """(column, uuid_share, email_share) of the trimmed non-empty cells of string columns."""
    names = [c for c, k in kinds(df).items() if k == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, uuid_share double, email_share double")
    t = lambda c: F.when(F.trim(_name(c)) != "", F.trim(_name(c)))
    share = lambda c, p: F.coalesce(F.avg(t(c).rlike(p).cast("double")), F.lit(0.0))
    rows = [F.struct(F.lit(c).alias("column"), share(c, UUID).alias("uuid_share"), share(c, EMAIL).alias("email_share")) for c in names]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def badges(profile: DataFrame) -> DataFrame:
    """H6: (column, badges), two at most, from ``scalars`` joined with ``pattern_shares``."""
    c = F.col
    constant = (c("non_null") > 0) & (c("distinct") <= 1)
    candidate = (c("count") > 0) & (c("non_null") == c("count")) & (c("non_null") >= 20) & (c("distinct_pct") >= 0.99) & ~constant
    high = ~candidate & (c("non_null") >= 20) & (c("distinct_pct") >= 0.9)
    uuid, email = F.coalesce(c("uuid_share") >= 0.9, F.lit(False)), F.coalesce(c("email_share") >= 0.9, F.lit(False))
    found = F.array(F.when(constant, "Constant"), F.when(candidate, "Candidate Key"), F.when(uuid, "UUID").when(email, "Email"), F.when((c("count") > 0) & (c("null_pct") >= 0.5), "Mostly Null"), F.when(high, "High Cardinality"))
    return profile.select("column", F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 2).alias("badges"))


def badged(df: DataFrame, exact: bool = False, of: DataFrame | None = None) -> DataFrame:
    return badges((scalars(df, exact) if of is None else of).join(F.broadcast(pattern_shares(df)), "column", "left"))  # a row a column


def extended(df: DataFrame) -> DataFrame:
    """H8 over the whole table: (column, variance, q25, median, q75, entropy, duplicate_ratio); duplicate_ratio is of whole rows."""
    ks = {c: k for c, k in kinds(df).items() if k != "other"}
    num = F.lit(None).cast("double")
    rows = []
    for c, k in ks.items():
        v = _name(c).cast("double") if k == "numeric" else None
        rows.append(F.struct(F.lit(c).alias("column"), (F.var_pop(v) if k == "numeric" else num).alias("variance")))
    stats = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    counts = sorted_run(df, list(ks))
    # entropy = log2(N) - sum(n log2 n) / N, so that counts need not be joined with their total
    entropy = counts.groupBy("column").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    whole = df.groupBy(*[_name(c) for c in df.columns if ks.get(c)]).agg(F.count("*").alias("_rows")).select("_rows").agg((1 - F.count("*") / F.sum("_rows")).alias("duplicate_ratio"))
    numeric = [c for c, k in ks.items() if k == "numeric"]
    quantiles = exact_quantiles(df, [], [0.25, 0.5, 0.75], run=counts) if numeric else df.sparkSession.createDataFrame([], "column string, q array<double>")
    out = stats.join(F.broadcast(entropy), "column", "left").join(F.broadcast(quantiles), "column", "left").join(F.broadcast(whole), F.lit(True))  # a row a column; one row
    return out.select("column", "variance", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q75"), "entropy", "duplicate_ratio")


def summarize(df: DataFrame, exact: bool = False) -> DataFrame:
    """The scalars with badges and top values as one row a column."""
    top = top_values(df).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("top_values"))
    s = scalars(df, exact)
    return s.join(F.broadcast(badged(df, exact, s)), "column", "left").join(F.broadcast(top), "column", "left")  # a row a column

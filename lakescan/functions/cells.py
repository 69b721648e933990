"""Types of text cells (E1-E4) as column expressions, and their merge as bit flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for null.
NULLS = ["", "null", "NULL", "Null", "na", "NA", "n/a", "N/A", "nil", "none", "None", "\\N"]
#: Texts that stand for booleans, in any case.
BOOLEANS = ["true", "false", "t", "f", "yes", "no", "y", "n"]
#: What Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A bit a kind; null and unknown have none.
BITS = {"boolean": 1, "integer": 2, "float": 4, "decimal": 8, "uuid": 16, "date": 32, "timestamp": 64, "time": 128, "json": 256, "string": 512, "array": 1024, "struct": 2048}
#: Shape of each time layout, its kind, and the pattern that checks the calendar.
LAYOUTS = [
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$", "timestamp", "yyyy-MM-dd'T'HH:mm:ss", 19),
    (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?$", "timestamp", "yyyy-MM-dd'T'HH:mm:ss", 19),
    (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d([.,]\d+)?$", "timestamp", "yyyy-MM-dd HH:mm:ss", 19),
    (r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d([.,]\d+)?$", "timestamp", "yyyy/MM/dd HH:mm:ss", 19),
    (r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d([.,]\d+)?$", "timestamp", "MM/dd/yyyy HH:mm:ss", 19),
    (r"^\d{4}-\d\d-\d\d$", "date", "yyyy-MM-dd", 10),
    (r"^\d{4}/\d\d/\d\d$", "date", "yyyy/MM/dd", 10),
    (r"^\d\d/\d\d/\d{4}$", "date", "MM/dd/yyyy", 10),
    (r"^\d\d-\d\d-\d{4}$", "date", "dd-MM-yyyy", 10),
]


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(text, F.lit(WHITE))


def is_null_text(text: Column) -> Column:
    """Null, or one of the twelve null texts between white space."""
    return text.isNull() | stripped(text).isin(NULLS)


def _typed(text: Column, of: Callable[[str], Column]) -> Column:
    """E2's kind as ``of`` writes it. A text without the start of a time meets none of the layouts, and one regular expression tells numbers from other texts."""
    t = stripped(text)
    exponent = t.contains("e") | t.contains("E")
    places = F.when(F.instr(t, ".") > 0, F.length(t) - F.instr(t, ".")).otherwise(0)
    number = F.when(~t.contains(".") & ~exponent & t.try_cast("long").isNotNull(), of("integer")).when(~exponent & (places > 6), of("decimal")).otherwise(of("float"))
    out = F.when(is_null_text(text), of("null")).when(F.lower(t).isin(BOOLEANS), of("boolean")).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number)
    out = out.when(F.lower(t).isin([s + w for s in ("", "+", "-") for w in ("inf", "infinity", "nan")]), of("float"))
    out = out.when((F.length(t) == 36) & t.rlike(r"^.{8}-.{4}-.{4}-.{4}-.{12}$") & F.lower(t).rlike("^[0-9a-f-]{36}$"), of("uuid"))
    times = F.when(t.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d([.,]\d+)?$"), of("time"))
    for shape, kind, layout, length in LAYOUTS:
        times = times.when(t.rlike(shape) & F.try_to_timestamp(F.substring(t, 1, length), F.lit(layout)).isNotNull(), of(kind))
    braces = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.coalesce(out, F.when(F.length(t).between(6, 40) & t.rlike(r"^\d\d(\d\d)?[-/:]"), times), F.when(braces, of("json")).otherwise(of("string")))


def cell_type(text: Column) -> Column:
    """Null, boolean, integer, float, decimal, uuid, date, timestamp, time, json or string, tested in that order."""
    return _typed(text, F.lit)


def cell_bit(text: Column) -> Column:
    """The bit of E2's kind, 0 for null."""
    return _typed(text, lambda kind: F.lit(BITS.get(kind, 0)))


def type_bit(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in BITS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(0))


def merged_type(bits: Column) -> Column:
    """The join of the kinds whose bits are set: numbers widen, date and timestamp meet, anything else is a string."""
    only = lambda *kinds: (bits != 0) & (bits.bitwiseAND(~sum(BITS[k] for k in kinds)) == 0)
    out = F.when(bits == 0, "null")
    for kind, bit in BITS.items():
        out = out.when(bits == bit, kind)
    return out.when(only("integer", "decimal"), "decimal").when(only("integer", "decimal", "float"), "float").when(only("date", "timestamp"), "timestamp").otherwise("string")


def column_types(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, type, nullable) over the cells of each group; without evidence a nullable string. One partial aggregate, one shuffle."""
    kind = cell_type(F.col(value))
    g = cells.withColumn("_kind", kind).groupBy(*keys).agg(F.bit_or(type_bit(F.col("_kind"))).alias("_bits"), F.max(F.col("_kind") == "null").alias("_null"))
    merged = merged_type(F.col("_bits"))
    return g.select(*keys, F.when(merged == "null", "string").otherwise(merged).alias("type"), (F.col("_null") | (F.col("_bits") == 0)).alias("nullable"))

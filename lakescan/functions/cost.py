"""Monthly storage cost of objects (B13). Rates are a table of (region, class, rate): a parameter, as they change.

``price_list`` makes that table from the provider's published price files, one of a region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_REGION = "us-east-1"
#: Dollars for a GB-month in the default region.
DEFAULT_RATES = {"STANDARD": 0.023, "INTELLIGENT_TIERING": 0.023, "STANDARD_IA": 0.0125, "ONEZONE_IA": 0.01, "GLACIER_IR": 0.004, "GLACIER": 0.0036, "DEEP_ARCHIVE": 0.00099}
#: Usage type without its region, volume type, storage class.
STORAGE_PRODUCTS = [
    ("TimedStorage-ByteHrs", "Standard", "STANDARD"),
    ("TimedStorage-SIA-ByteHrs", "Standard - Infrequent Access", "STANDARD_IA"),
    ("TimedStorage-ZIA-ByteHrs", "One Zone - Infrequent Access", "ONEZONE_IA"),
    ("TimedStorage-GIR-ByteHrs", "Glacier Instant Retrieval", "GLACIER_IR"),
    ("TimedStorage-GlacierByteHrs", "Amazon Glacier", "GLACIER"),
    ("TimedStorage-GDA-ByteHrs", "Glacier Deep Archive", "DEEP_ARCHIVE"),
    ("TimedStorage-INT-FA-ByteHrs", "Intelligent-Tiering Frequent Access", "INTELLIGENT_TIERING"),
    ("TimedStorage-RRS-ByteHrs", "Reduced Redundancy", "REDUCED_REDUNDANCY"),
    ("TimedStorage-XZ-ByteHrs", "Express One Zone", "EXPRESS_ONEZONE"),
]
#: Fixed value: a region's short name before the usage type.
USAGE_PREFIX = r"^[A-Z]{2,4}[0-9]?-(?=TimedStorage-)"
OFFER = """products map<string, struct<attributes: map<string, string>>>,
terms struct<OnDemand: map<string, map<string, struct<priceDimensions: map<string, struct<beginRange: string, unit: string, pricePerUnit: map<string, string>>>>>>>"""
GB = 1 << 30
LEAST_BILLED = 128 << 10
INDEX_OVERHEAD = 32 << 10
NAME_OVERHEAD = 8 << 10


def rates_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rates from a CSV file with header (region, class, rate), or the default region's."""
    if path:
        return spark.read.schema("region string, class string, rate double").csv(path, header=True)
    return spark.createDataFrame([(DEFAULT_REGION, k, v) for k, v in DEFAULT_RATES.items()], "region string, class string, rate double")


def price_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(region, class, rate) of the published price files (JSON) under ``paths``: the first tier's dollars for a GB-month.

    Products and terms are exploded apart and meet by their number, so that no file's terms are copied to each product.
    Products that are no storage of a listed class are left out. Rates of one class and region that differ raise an error.
    """
    offers = spark.read.schema(OFFER).json(paths, multiLine=True)
    kinds = spark.createDataFrame(STORAGE_PRODUCTS, "_usage string, _volume string, class string")
    a = lambda name: F.col("product.attributes")[name]
    products = offers.select(F.explode("products").alias("sku", "product")).where(a("locationType") == "AWS Region")
    products = products.select("sku", a("regionCode").alias("region"), F.regexp_replace(a("usagetype"), USAGE_PREFIX, "").alias("_usage"), a("volumeType").alias("_volume")).join(kinds, ["_usage", "_volume"])
    terms = offers.select(F.explode("terms.OnDemand").alias("sku", "offers")).select("sku", F.explode("offers").alias("_", "offer")).select("sku", F.explode("offer.priceDimensions").alias("_", "price"))
    terms = terms.where("price.beginRange = '0' AND price.unit = 'GB-Mo'").select("sku", F.col("price.pricePerUnit")["USD"].try_cast("double").alias("rate")).where("rate IS NOT NULL")
    g = products.join(terms, "sku").groupBy("region", "class").agg(F.min("rate").alias("low"), F.max("rate").alias("high"))
    differ = F.raise_error(F.concat(F.lit("rates differ: "), "region", F.lit(" "), "class")).cast("double")
    return g.select("region", "class", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(differ).alias("rate"))


def storage_class(c: Column) -> Column:
    clean = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(clean == "", F.lit("STANDARD")).otherwise(clean)


def cost_of(size: Column, cls: Column, rate: Column, standard: Column) -> Column:
    billed = F.when(cls.isin("STANDARD_IA", "ONEZONE_IA", "GLACIER_IR"), F.greatest(size, F.lit(LEAST_BILLED))).otherwise(size)
    extra = F.when(cls.isin("GLACIER", "DEEP_ARCHIVE"), INDEX_OVERHEAD * rate + NAME_OVERHEAD * standard).otherwise(F.lit(0.0))
    return (billed * rate + extra) / GB


def with_cost(objects: DataFrame, rates: DataFrame, region: str = "region", cls: str = "storage_class", size: str = "size") -> DataFrame:
    """``objects`` with ``cost``. A region without rates is billed as the default one, a class without a rate as STANDARD."""
    r = rates.select(F.col("region").alias("_region"), F.upper("class").alias("_class"), F.col("rate").alias("_rate"))
    known = r.select(F.col("_region").alias("_known")).distinct()
    standard = r.where("_class = 'STANDARD'").select(F.col("_region").alias("_sregion"), F.col("_rate").alias("_standard"))
    # The rate table is the caller's: the planner broadcasts it where its size is small enough.
    o = objects.withColumn("_cls", storage_class(F.col(cls)))
    o = o.join(known, F.col(region) == F.col("_known"), "left").withColumn("_priced", F.coalesce("_known", F.lit(DEFAULT_REGION)))
    o = o.join(standard, F.col("_priced") == F.col("_sregion"), "left").join(r, (F.col("_priced") == F.col("_region")) & (F.col("_cls") == F.col("_class")), "left")
    o = o.withColumn("cost", cost_of(F.col(size), F.col("_cls"), F.coalesce("_rate", "_standard"), F.col("_standard")))
    return o.select(*objects.columns, F.col("_priced").alias("price_region"), "cost")

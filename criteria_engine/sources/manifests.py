"""Which folders of the attempts log hold, and folders in buckets by the first bits of a digest."""

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from criteria_engine.storage import names, read_record

# Rows of a bucket, and the most bits of a digest that name one.
BUCKET_ROWS = 1_000_000
PREFIX_BITS = 12

NONE = {"version": 0, "merged": 0, "segments": [], "texts": [], "absorbed": []}


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest one.

    It holds its version, merged (the last run in segments), segments and texts (name, rows, bits of each),
    and absorbed (additions of texts that its texts include).
    """
    found = [name for name in names(spark, f"{path}/manifests") if name.endswith(".json")]
    return read_record(spark, f"{path}/manifests/{found[-1]}") if found else NONE


def digest_prefix(digest: str, bits: int = PREFIX_BITS) -> Column:
    """The first bits of a digest, as a number."""
    first = F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int")
    return F.shiftright(F.coalesce(first, F.lit(0)), 16 - bits)


def prefixes(near: DataFrame, digest: str) -> set[int]:
    """The prefixes of a table's digests: 4,096 numbers at most."""
    return {row[0] for row in near.select(digest_prefix(digest)).distinct().collect()}


def bucket_bits(rows: int, bucket_rows: int) -> int:
    return min(PREFIX_BITS, max(0, ceil(log2(max(rows, 1) / bucket_rows))))


def read_buckets(spark: SparkSession, folder: str, schema: T.StructType, bits: int, wanted: set[int] | None = None) -> DataFrame:
    """A folder of `write_buckets`; with prefixes that are `wanted`, only their buckets."""
    placed = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    read = spark.read.schema(placed).parquet(folder)
    if wanted is not None and bits:
        buckets = sorted({p >> PREFIX_BITS - bits for p in wanted})
        if len(buckets) < 1 << bits:
            read = read.where(F.col("bucket").isin(buckets))
    return read


def write_buckets(table: DataFrame, folder: str, digest: str, rows: int, bucket_rows: int, by=()) -> int:
    """Write about `rows` rows in buckets by `digest`, then `by` columns; returns the bits that name a bucket.

    A bucket's rows go to as many tasks as they need.
    """
    bits = bucket_bits(rows, bucket_rows)
    piece = F.pmod(F.xxhash64(digest), F.lit(max(1, rows // (bucket_rows << bits))))
    placed = table.withColumn("bucket", digest_prefix(digest, bits)).repartition("bucket", *by, piece)
    placed.write.partitionBy("bucket", *by).parquet(folder)
    return bits

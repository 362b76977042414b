"""A Bloom filter of a key column, built by an aggregate and applied where rows are scanned."""

from pyspark.sql import Column, DataFrame, functions as F

HASHES = 4
# Bits per key, and the most bits of a filter: 8 MB, the bound of what is sent to every task.
KEY_BITS = 10
MOST_BITS = 1 << 26


def filter_bits(n: int) -> int:
    """A power of two of bits for n keys, or 0 where MOST_BITS hold too little to be of use."""
    if n > MOST_BITS // 2:
        return 0
    return min(MOST_BITS, max(64, 1 << (KEY_BITS * n - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    """HASHES places from the two halves of one 64-bit hash."""
    hashed = F.xxhash64(key)
    first, step = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)
    return [(first + i * step).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def bloom(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the filter's words, of 64 bits each.

    Bits are combined per word before the shuffle; `bits` bounds what is gathered at the end.
    """
    each = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    word = F.shiftright("place", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    filled = each.groupBy(word).agg(F.bit_or(bit).alias("set"))
    all_words = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").withColumn("set", F.lit(0).cast("long"))
    words = filled.unionByName(all_words).groupBy("word").agg(F.bit_or("set").alias("set"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "set")))
    return words.agg(F.transform(in_order, lambda w: w["set"]).alias("words"))


# What a key takes at least when it is broadcast.
ROW_BYTES = 16


def held_back(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """`rows` for a join with the `n` of `keys`: as they are where Spark sends the keys to them, else filtered."""
    bound = rows.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return likely_in(rows, keys, key, n) if n * ROW_BYTES > _bytes(bound) else rows


def _bytes(setting: str) -> int:
    """A size as Spark writes it: 10MB, 256k, 10485760b or -1."""
    number = setting.strip().lower().removesuffix("b")
    return int(number[:-1]) << 10 * (1 + "kmgtp".index(number[-1])) if number[-1:].isalpha() else int(number)


def likely_in(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is among the `n` of `keys`, and a few others; as they are if n is very large."""
    bits = filter_bits(n)
    if not n or not bits:
        return rows
    words = bloom(keys, key, bits).scalar()

    def has(place: Column) -> Column:
        word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
        return F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int"))) == 1

    test = F.lit(True)
    for place in _places(F.col(key), bits):
        test &= has(place)
    return rows.where(test)

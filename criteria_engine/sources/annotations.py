"""Annotation files: one tab-separated record per line, quotes are plain text."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from criteria_engine.functions.text import key_hash, text_hash
from criteria_engine.operators.lines import parse_lines
from criteria_engine.schemas import ANNOTATION_COLUMNS, KEY, ORDER, STAGED
from criteria_engine.sources.split_index import first_lines, needed, only, refresh
from criteria_engine.storage import shared_folder, store


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Text lines with their place in the input: (src_file, src_block, src_row) is file order."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().alias("src_row"),
        F.col("value").alias("line"),
    )


def load_annotations(spark: SparkSession, path, num_rows: int | None = None, index: str | None = None) -> DataFrame:
    """Valid annotations of one or more files, with their place columns.

    `num_rows` keeps the first valid rows in file order; None keeps all. Files are then
    read in path order, in groups that double, until the rows are found. With `index`, a
    folder of line counts (`split_index`), a later call reads the files that hold the rows only.
    """
    if num_rows is None:
        return parse_lines(read_lines(spark, path))
    if num_rows < 0:
        raise ValueError(f"number of rows must not be negative: {num_rows}")
    if index is not None:
        return _indexed(spark, path, num_rows, index)
    files = sorted(spark.read.text(path).inputFiles())  # as src_file names them
    folder = shared_folder(spark)
    kept, start, size = [], 0, 1
    while start < len(files) and num_rows > 0:
        group = read_lines(spark, only(files[start : start + size]))
        found, seen = store(parse_lines(group), f"{folder}/group_{start}")
        kept.append(first_by_split(found, num_rows) if seen["n"] > num_rows else found)
        num_rows -= min(num_rows, seen["n"])
        start, size = start + size, size * 2
    if not kept:
        return parse_lines(read_lines(spark, path)).limit(0)
    return reduce(DataFrame.unionByName, kept)


def _indexed(spark: SparkSession, path, num_rows: int, index: str) -> DataFrame:
    whole, cut = needed(refresh(spark, path, index, num_rows), num_rows) if num_rows else ([], None)
    kept = [parse_lines(read_lines(spark, only(whole)))] if whole else []
    if cut:
        name, n, end = cut
        lines = read_lines(spark, only([name]))
        if end is not None:
            # wherever splits begin now, those that begin here or later hold no such row
            lines = lines.where(F.col("src_block") < end)
        found, _ = store(parse_lines(lines), f"{shared_folder(spark)}/cut")
        kept.append(first_by_split(found, n))
    if not kept:
        return parse_lines(read_lines(spark, path)).limit(0)
    return reduce(DataFrame.unionByName, kept)


def first_by_split(rows: DataFrame, n: int) -> DataFrame:
    """The first n of stored rows in file order.

    Whole splits are taken by their counts; only the split in which the n-th row stands
    is ordered, so no task holds n rows.
    """
    split = ["src_file", "src_block"]
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*split).agg(F.count("*").alias("_size"))  # one row per split
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    placed = rows.join(sizes.where(F.col("_before") < n), split)
    whole = F.col("_before") + F.col("_size") <= n
    place = F.row_number().over(Window.partitionBy(*split).orderBy("src_row"))
    cut = placed.where(~whole).withColumn("_place", place).where(F.col("_before") + F.col("_place") <= n)
    return placed.where(whole).select(rows.columns).unionByName(cut.select(rows.columns))


def stage_annotations(annotations: DataFrame, path: str, key=KEY, counts: DataFrame | None = None) -> DataFrame:
    """Store annotations as parquet with digests of key and text, and return them numbered.

    Runs read the stored table several times, mostly just (seq, key_hash), so the
    text is read and hashed once.
    """
    annotations.select(
        *ORDER, key_hash(key).alias("key_hash"), text_hash().alias("text_hash"), *ANNOTATION_COLUMNS
    ).write.mode("overwrite").parquet(path)
    return number_rows(annotations.sparkSession.read.schema(STAGED).parquet(path), f"{path}_splits", counts)


def number_rows(staged: DataFrame, path: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Replace the place columns by `seq`, a number that is unique and rises in file order.

    Only one row per input split is ordered globally: each split gets the number
    of row ids before it, and adds its own. These are stored in `path`. With `counts`, the rows
    of a split index, a file's numbers begin at the number of lines in all files before it,
    so that files which come later continue where those before them ended.
    """
    ids = F.col("src_row")
    spans = staged.groupBy("src_file", "src_block").agg(
        F.min(ids).alias("_low"), (F.max(ids) - F.min(ids) + 1).alias("_size")
    )
    spans, _ = store(spans, path or f"{shared_folder(staged.sparkSession)}/splits")
    first, placed = F.lit(0), Window.orderBy("src_file", "src_block")
    if counts is not None:
        spans = spans.join(first_lines(counts).withColumnRenamed("first_line", "_first"), "src_file")
        first, placed = F.col("_first"), Window.partitionBy("src_file").orderBy("src_block")
    before = F.coalesce(F.sum("_size").over(placed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spans.select("src_file", "src_block", (first + before - F.col("_low")).alias("_offset"))
    return staged.join(offsets, ["src_file", "src_block"]).select(
        (ids + F.col("_offset")).alias("seq"), "key_hash", "text_hash", *ANNOTATION_COLUMNS
    )

"""Line counts of annotation files, stored once, so that files are not read again to be counted.

The index is a folder of additions, one row per input split. An addition counts once its record
is written. A row holds for a file while the file's length and time are the ones that were
counted. Files are counted in path order and only as far as somebody asked.
"""

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from criteria_engine.operators.lines import is_valid
from criteria_engine.storage import discard, names, read_record, write_record

FILE = ("src_file", "length", "modified")
COUNTS = "src_file string, length bigint, modified timestamp, src_block bigint, lines bigint, valid bigint"
# Additions after which the next one holds everything.
ADDITIONS = 8


def only(files: list[str]) -> list[str]:
    """Paths that name just these files, given as src_file names them; a path may hold glob characters."""
    return [unquote(f).translate({ord(c): f"\\{c}" for c in "{}[]*?\\"}) for f in files]


def _place(read: DataFrame) -> list:
    columns = ("file_path", "file_size", "file_modification_time")
    return [F.col(f"_metadata.{c}").alias(name) for c, name in zip(columns, FILE)]


def listed(spark: SparkSession, path) -> DataFrame:
    """A row per file with its length and time; no content is read."""
    read = spark.read.format("binaryFile").load(path)
    return read.select(*_place(read))


def count_lines(spark: SparkSession, path) -> DataFrame:
    """Lines and valid lines of every input split, in one pass."""
    read = spark.read.text(path)
    lines = read.select(*_place(read), F.col("_metadata.file_block_start").alias("src_block"), "value")
    counted = lines.groupBy(*FILE, "src_block").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(is_valid("value")).alias("valid")
    )
    # a file without lines (an empty archive, say) has a row too
    none = [F.lit(0).cast("bigint").alias(c) for c in ("src_block", "lines", "valid")]
    return counted.unionByName(listed(spark, path).select(*FILE, *none))


def _additions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """Number of each addition that counts, from the last whole one on, and whether it is whole."""
    found = sorted(int(n.removesuffix(".json")) for n in names(spark, f"{folder}/records") if n.endswith(".json"))
    kept: list[tuple[int, bool]] = []
    for number in reversed(found):
        kept.append((number, read_record(spark, f"{folder}/records/{number:08d}.json")["whole"]))
        if kept[-1][1]:
            break
    return kept[::-1]


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """The index's rows; a file that was counted twice has those of its last addition."""
    parts = [
        spark.read.schema(COUNTS).parquet(f"{folder}/counts/{n:08d}").withColumn("addition", F.lit(n))
        for n, _ in _additions(spark, folder)
    ]
    if not parts:
        return spark.createDataFrame([], COUNTS)
    rows = reduce(DataFrame.unionByName, parts)
    last = F.max("addition").over(Window.partitionBy(*FILE))
    return rows.withColumn("last", last).where("addition = last").drop("addition", "last")


def _add(spark: SparkSession, folder: str, rows: DataFrame) -> None:
    before = _additions(spark, folder)
    number, whole = before[-1][0] + 1 if before else 1, len(before) >= ADDITIONS
    if whole:
        rows = rows.unionByName(counts(spark, folder).join(rows.select("src_file").distinct(), "src_file", "left_anti"))
    rows.write.mode("overwrite").parquet(f"{folder}/counts/{number:08d}")  # may hold what broke off
    write_record(spark, f"{folder}/records/{number:08d}.json", {"whole": whole})
    if whole:
        # what this one replaces stays for readers that began before; what the one before replaced goes
        for name in names(spark, f"{folder}/counts"):
            if int(name) < before[0][0]:
                discard(spark, f"{folder}/counts/{name}")
                discard(spark, f"{folder}/records/{name}.json")


def refresh(spark: SparkSession, path, folder: str, num_rows: int | None = None) -> DataFrame:
    """The index's rows of the files as they are now, counted until `num_rows` valid rows are known.

    None counts all files. Files that are new or changed are counted in path order, in groups
    that double; the others are not read. Rows of files behind the last group may be there too.
    """
    size, tried = 1, set()
    while True:
        files = listed(spark, path)
        rows = counts(spark, folder).join(files, list(FILE), "left_semi")
        known = rows.groupBy("src_file").agg(F.sum("valid").alias("valid"))
        # a row per file, whose names the driver lists anyway
        per_file = files.join(known, "src_file", "left").orderBy("src_file").select("src_file", "length", "valid").collect()
        open_files, found = [], 0
        for row in per_file:
            if row["valid"] is None and row["length"]:
                open_files.append(row["src_file"])
            elif row["valid"] is not None and not open_files:
                found += row["valid"]
        if not open_files or (num_rows is not None and found >= num_rows):
            return rows
        group = open_files if num_rows is None else open_files[:size]
        if tried & set(group):
            raise RuntimeError(f"files change while they are counted: {sorted(tried & set(group))[:3]}")
        tried |= set(group)
        _add(spark, folder, count_lines(spark, only(group)))
        size *= 2


def needed(rows: DataFrame, num_rows: int) -> tuple[list[str], tuple[str, int, int | None] | None]:
    """Files whose valid rows are all among the first `num_rows`, and the one that is cut, if any.

    The cut file comes with the rows to take and the end of the last split that holds any, None
    for the file's end.
    """
    per_split = rows.groupBy("src_file", "src_block").agg(F.sum("valid").alias("valid"))
    behind = Window.partitionBy("src_file").orderBy("src_block")
    per_split = per_split.withColumn("end", F.lead("src_block").over(behind))
    earlier = Window.orderBy("src_file", "src_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_split.withColumn("before", F.coalesce(F.sum("valid").over(earlier), F.lit(0)))
    first = placed.where((F.col("before") < num_rows) & (F.col("valid") > 0))
    # a row per file that is read
    ends = first.groupBy("src_file").agg(F.max_by("end", "src_block").alias("end"), F.min("before").alias("before"))
    total = rows.groupBy("src_file").agg(F.sum("valid").alias("all"))
    found = ends.join(total, "src_file").orderBy("src_file").collect()
    whole = [r["src_file"] for r in found if r["before"] + r["all"] <= num_rows]
    cut = [r for r in found if r["before"] + r["all"] > num_rows]  # the last one, if any
    return whole, (cut[0]["src_file"], num_rows - cut[0]["before"], cut[0]["end"]) if cut else None


def first_lines(rows: DataFrame) -> DataFrame:
    """src_file and the number of lines in the files before it."""
    earlier = Window.orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("src_file").agg(F.sum("lines").alias("lines"))  # a row per file
    return sizes.select("src_file", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("first_line"))

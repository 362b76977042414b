import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from criteria_engine.operators.lines import is_valid
from criteria_engine.schemas import ANNOTATION_COLUMNS, ORDER
from criteria_engine.sources import annotations, split_index
from criteria_engine.sources.annotations import load_annotations, stage_annotations
from criteria_engine.sources.split_index import refresh
from test_annotations import CASES


@pytest.fixture()
def opened(monkeypatch):
    """Files that are read for counting, and for their rows."""
    seen = {"counted": [], "read": []}
    count, read = split_index.count_lines, annotations.read_lines
    monkeypatch.setattr(split_index, "count_lines", lambda s, p: seen["counted"].extend(p) or count(s, p))
    monkeypatch.setattr(annotations, "read_lines", lambda s, p: seen["read"].extend(p) or read(s, p))
    return seen


def write(folder, k, n=15):
    """Ten of fifteen lines are valid."""
    lines = [f"D{k}.txt\t{i % 3}\tT\tINCL\t{k} {i}" for i in range(n)]
    (folder / f"in [{k:02}] {{x}}.tsv").write_text("\n".join(lines) + "\n")


def texts(rows):
    return [r.criteria_text for r in rows.orderBy(*ORDER).collect()]


def valid(files, n=15):
    return [f"{k} {i}" for k in files for i in range(n) if i % 3 < 2]


def names(paths):
    return sorted(int(p.rsplit("[", 1)[1][:2]) for p in paths)


def test_same_lines_are_valid(spark):
    lines = spark.createDataFrame([(c,) for c, _ in CASES], "line string")
    assert [r[0] for r in lines.select(is_valid()).collect()] == [record is not None for _, record in CASES]


def test_a_second_call_reads_no_other_file(spark, tmp_path, opened):
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for k in range(12):
        write(source, k)
    path = str(source)
    assert texts(load_annotations(spark, path, 25, index)) == valid(range(12))[:25]
    assert names(opened["counted"]) == [0, 1, 2]
    for n, read in ((25, [0, 1, 2]), (10, [0]), (11, [0, 1]), (30, [0, 1, 2]), (1, [0])):
        opened["counted"].clear(), opened["read"].clear()
        assert texts(load_annotations(spark, path, n, index)) == valid(range(12))[:n]
        assert (opened["counted"], names(opened["read"])) == ([], read)
    assert texts(load_annotations(spark, path, 1000, index)) == valid(range(12))
    assert names(opened["counted"]) == list(range(3, 12))
    assert load_annotations(spark, path, 0, index).count() == 0


def test_a_changed_file_is_counted_again(spark, tmp_path, opened):
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for k in (1, 3):
        write(source, k)
    refresh(spark, str(source), index)
    opened["counted"].clear()
    write(source, 2)  # a new one between them
    write(source, 3, 30)  # a longer one
    want = valid([1, 2]) + valid([3], 30)
    assert texts(load_annotations(spark, str(source), 1000, index)) == want
    assert names(opened["counted"]) == [2, 3]
    before = os.stat(next(source.glob("*01*")))
    os.utime(next(source.glob("*01*")), (before.st_atime, before.st_mtime + 5))
    opened["counted"].clear()
    next(source.glob("*02*")).unlink()
    assert texts(load_annotations(spark, str(source), 1000, index)) == valid([1]) + valid([3], 30)
    assert names(opened["counted"]) == [1]


def test_additions_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_index, "ADDITIONS", 2)
    source, index = tmp_path / "in", tmp_path / "index"
    source.mkdir()
    for k in range(9):
        write(source, k, 15 + k)
        counted = refresh(spark, str(source), str(index))
        assert counted.agg(F.sum("lines")).first()[0] == sum(15 + j for j in range(k + 1))
        assert len(os.listdir(index / "counts")) <= 5
    # an addition without its record, from a call that broke off, counts for nothing
    stray = split_index.count_lines(spark, str(source))
    last = max(int(n[:8]) for n in os.listdir(index / "records") if n.endswith(".json"))
    stray.write.parquet(str(index / f"counts/{last + 1:08d}"))
    assert refresh(spark, str(source), str(index)).agg(F.sum("lines")).first()[0] == sum(range(15, 24))
    write(source, 20)
    assert refresh(spark, str(source), str(index)).agg(F.sum("lines")).first()[0] == sum(range(15, 24)) + 15


def test_splits_may_be_cut_elsewhere_later(spark, tmp_path):
    draw = random.Random(4)
    lines = [f"D.txt\t{draw.choice('012')}\tT\tINCL\t{i} {'x' * draw.randrange(90)}" for i in range(400)]
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.tsv").write_text("\n".join(f"{line}" for line in lines[200 * k : 200 * k + 200]) + "\n")
    want = [line.split("\t")[4].strip() for line in lines if line.split("\t")[1] != "2"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        assert refresh(spark, str(source), index).count() > 20
        for size in ("700", "450", "1300", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for n in (1, 17, 100, 150, 200, len(want)):
                assert texts(load_annotations(spark, str(source), n, index)) == want[:n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_later_files_continue_the_numbers(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for k in range(4):
        write(source, k)
    counted = refresh(spark, str(source), index)
    staged = stage_annotations(load_annotations(spark, str(source)), str(tmp_path / "all"), counts=counted)
    every = {r.criteria_text: r.seq for r in staged.collect()}
    assert [t for t, _ in sorted(every.items(), key=lambda x: x[1])] == valid(range(4))
    assert len(set(every.values())) == 40
    write(source, 4)
    counted = refresh(spark, str(source), index)
    late = load_annotations(spark, str(next(source.glob("*04*"))).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"))
    numbered = stage_annotations(late, str(tmp_path / "late"), counts=counted)
    found = [(r.criteria_text, r.seq) for r in numbered.orderBy("seq").collect()]
    assert [t for t, _ in found] == valid([4]) and found[0][1] == 60 > max(every.values())


def test_files_without_lines(spark, tmp_path):
    source, index = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    (source / "a.tsv").write_text("")
    with gzip.open(source / "b.tsv.gz", "wt") as out:
        out.write("")
    (source / "c.tsv").write_text("no fields\n")
    assert load_annotations(spark, str(source), 5, index).count() == 0
    write(source, 7)
    assert texts(load_annotations(spark, str(source), 5, index)) == valid([7])[:5]
    assert load_annotations(spark, str(source), 5, index).columns == [*ORDER, *ANNOTATION_COLUMNS]

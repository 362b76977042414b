import random

import pytest
from pyspark.sql import functions as F

from criteria_engine.fixed_values import WHITESPACE
from criteria_engine.operators.lines import first_n, parse_lines
from criteria_engine.sources import annotations
from criteria_engine.schemas import ANNOTATION_COLUMNS, ORDER
from criteria_engine.sources.annotations import (
    load_annotations,
    read_lines,
    stage_annotations,
)

P = "annot-NOT_prior_therapy_"

CASES = [
    (f"{P}anti-CTLA-4.txt\t0\tNCT1\tINCL\tPrior X", ("anti-CTLA-4", 0, "NCT1", "INCL", "Prior X")),
    (f"{P}A.txt\t2\tNCT1\tINCL\tt", None),
    (f"{P}A.txt\t01\tNCT1\tINCL\tt", None),
    (f"{P}A.txt\t 1 \tNCT1\tEXCL\t t ", ("A", 1, "NCT1", "EXCL", "t")),
    (f"{P}A.txt\t0\tNCT1\tINCL", None),
    (f"{P}A.txt\t0\tNCT1\tINCL\t", None),
    (f"{P}A.txt\t0\tNCT1\tINCL\tt\tnote", ("A", 0, "NCT1", "INCL", "t")),
    (f"{P}A.txt\t0\tNCT1\tINCL\t\tnote", ("A", 0, "NCT1", "INCL", "")),
    ("\t0\tNCT1\tINCL\tt", None),
    (f"\t{P}A.txt\t1\tNCT1\tINCL\tt", ("A", 1, "NCT1", "INCL", "t")),
    ("", None),
    ("   ", None),
    ("other.txt\t1\tNCT1\tINCL\tt", ("other.txt", 1, "NCT1", "INCL", "t")),
    (f"{P}A.txt.bak\t1\tNCT1\tINCL\tt", ("A", 1, "NCT1", "INCL", "t")),
    (f"{P}A.txt_B.txt\t1\tNCT1\tINCL\tt", ("A.txt_B", 1, "NCT1", "INCL", "t")),
    (f"{P}.txt\t1\tNCT1\tINCL\tt", (f"{P}.txt", 1, "NCT1", "INCL", "t")),
    (f"{P}A.txt \t1\tNCT1\tINCL\tt", ("A", 1, "NCT1", "INCL", "t")),
    (f"{P}A.txt\t1\tNCT1\tOTHER\t\xa0t\xa0", ("A", 1, "NCT1", "OTHER", "t")),
    (
        f"{P}A.txt\t1\tNCT1\tincl\tuse {{drug_name}} 100%",
        ("A", 1, "NCT1", "incl", "use {drug_name} 100%"),
    ),
    (f"{P}A.txt\t1\t\tEXCL\tt", ("A", 1, "", "EXCL", "t")),
    (f'{P}A.txt\t1\tNCT1\tEXCL\t"quoted" \\n', ("A", 1, "NCT1", "EXCL", '"quoted" \\n')),
]


def expected(line):
    """The rules of the loader on one line: its record, or None."""
    fields = line.strip().split("\t")
    if len(fields) < 5 or fields[1].strip() not in {"0", "1"}:
        return None
    name, end = fields[0], fields[0].rfind(".txt")
    if name.startswith(P) and end > len(P) and "\n" not in name[:end]:
        name = name[len(P) : end]
    label, trial, section, text = (field.strip() for field in fields[1:5])
    return name, int(label), trial, section, text


def records(df):
    return [tuple(r) for r in df.select(*ANNOTATION_COLUMNS).collect()]


def test_cases(spark):
    lines = spark.createDataFrame([(line,) for line, _ in CASES], "line string")
    assert records(parse_lines(lines)) == [want for _, want in CASES if want]
    assert [expected(line) for line, _ in CASES] == [want for _, want in CASES]


def test_random_lines(spark):
    rng = random.Random(7)
    parts = ["0", "1", "2", "\t", "\t", "\t", "\t", ".txt", P, "x", " ", "INCL", "é", *WHITESPACE]
    parts = [p for p in parts if p not in "\r\n"]
    some = []
    for _ in range(8000):
        noise = ["".join(rng.choices(parts, k=rng.randrange(4))) for _ in range(5)]
        whole = [P + "D.txt", rng.choice("01"), "NCT", "INCL", "text"]
        fields = [rng.choice(pair) for pair in zip(noise, whole)]
        some.append(rng.choice(["", " ", "\t"]) + "\t".join(fields))
    lines = spark.createDataFrame(enumerate(some), "i int, line string")
    got = {r["i"]: tuple(r[c] for c in ANNOTATION_COLUMNS) for r in parse_lines(lines).collect()}
    want = {i: expected(line) for i, line in enumerate(some)}
    assert got == {i: record for i, record in want.items() if record}
    assert len(got) > 300


@pytest.fixture()
def split_files(spark, tmp_path):
    """Two files that Spark reads in many small splits."""
    folder = tmp_path / "in put"
    folder.mkdir()
    texts = []
    for name in ("b.tsv", "a.tsv"):
        lines = [f"{P}D{i}.txt\t{i % 2}\tT{name}\tINCL\ts{'x' * (i % 37)}" for i in range(300)]
        (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        texts = lines + texts
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield str(folder), [expected(line) for line in texts]
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_order(spark, split_files):
    path, want = split_files
    loaded = load_annotations(spark, path)
    assert loaded.rdd.getNumPartitions() > 10
    assert records(loaded.orderBy(*ORDER)) == want
    for n in (0, 1, 7, 450, 10_000):
        assert records(load_annotations(spark, path, n).orderBy(*ORDER)) == want[:n]


def test_no_task_orders_the_first_rows(spark, split_files):
    plan = load_annotations(spark, split_files[0], 450)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan


def test_each_line_is_stripped_and_split_once(spark, split_files):
    plan = load_annotations(spark, split_files[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("trim(line") == 1
    assert plan.count("split(") == 1
    assert "Exchange" not in plan


def test_negative_limit():
    with pytest.raises(ValueError):
        first_n(None, -1, ["seq"])


def test_numbers_follow_file_order(spark, split_files, tmp_path):
    path, want = split_files
    rows = stage_annotations(load_annotations(spark, path), str(tmp_path / "staged"))
    assert records(rows.orderBy("seq")) == want
    assert rows.select("seq").distinct().count() == len(want)
    assert rows.agg(F.min("seq")).first()[0] == 0


def test_numbers_without_a_broadcast(spark, split_files, tmp_path):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        path, want = split_files
        loaded = load_annotations(spark, path)
        assert records(stage_annotations(loaded, str(tmp_path / "staged")).orderBy("seq")) == want
    finally:
        spark.conf.set(name, before)


def test_line_ends_and_encoding(spark, tmp_path):
    record = f"{P}D.txt\t1\tT\tINCL\t".encode()
    data = b"\xef\xbb\xbf" + record + b"a\r\n" + record + b"b\r" + record + b"\xff\n"
    (tmp_path / "x.tsv").write_bytes(data)
    got = records(load_annotations(spark, str(tmp_path / "x.tsv")).orderBy(*ORDER))
    # the byte-order mark is dropped; a broken byte does not stop the load
    assert [r[0] for r in got] == ["D", "D", "D"]
    assert [r[4] for r in got][:2] == ["a", "b"]
    assert len(got[2][4]) == 1


def test_lines_carry_their_place(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("one\ntwo\n")
    assert read_lines(spark, str(tmp_path)).columns == [*ORDER, "line"]


def test_empty_input(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("\n \n")
    rows = stage_annotations(load_annotations(spark, str(tmp_path / "x.tsv")), str(tmp_path / "s"))
    assert rows.count() == 0


def test_the_first_rows_come_from_few_files(spark, tmp_path, monkeypatch):
    for k in range(40):
        lines = [f"D{k}.txt\t{i % 3}\tT\tINCL\t{k} {i}" for i in range(15)]  # ten of fifteen are valid
        (tmp_path / f"in [{k:02}] {{x}}.tsv").write_text("\n".join(lines) + "\n")
    opened = []
    plain = annotations.read_lines

    def counted(spark, path):
        opened.extend(path)
        return plain(spark, path)

    monkeypatch.setattr(annotations, "read_lines", counted)
    want = [f"{k} {i}" for k in range(40) for i in range(15) if i % 3 < 2]
    for n, files in ((25, 3), (1, 1), (10, 1), (395, 40)):
        opened.clear()
        got = annotations.load_annotations(spark, str(tmp_path), n).orderBy(*ORDER).collect()
        assert [r.criteria_text for r in got] == want[:n]
        assert len(opened) == files
    assert annotations.load_annotations(spark, str(tmp_path), 0).count() == 0


def test_the_first_rows_of_many_splits(spark, tmp_path):
    rows = [(f"f{i % 4}", i % 3, i, f"d{i}") for i in range(240)]
    table = spark.createDataFrame(rows, "src_file string, src_block long, src_row long, drug_name string")
    for n in (0, 1, 20, 37, 240, 500):
        got = sorted((r[0], r[1], r[2]) for r in annotations.first_by_split(table.repartition(5), n).collect())
        assert got == sorted(r[:3] for r in rows)[:n]

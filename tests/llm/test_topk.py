import random

from pyspark.sql import functions as F

from criteria_engine.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def brute(rows, step, k):
    from math import floor, isfinite

    usable = [
        (i, [floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    ]
    out = []
    queries = {}
    for i, v in usable:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, w in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_same_as_brute_force(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, [draw.choice([0.0, 0.25, -0.5, draw.gauss(0, 0.3)]) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 230)]  # ties
    rows += [(10, rows[3][1]), (10, rows[4][1]), (77, rows[5][1]), (77, rows[5][1])]  # repeated ids
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [1.0])]
    rows += [(304, []), (305, [1.0]), (310, [0.5] * 9), (0, [0.0] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(4)
    kept = [(r.vec_id, r.embedding) for r in table.collect()]
    for size, least in ((1000, 4096), (8000, 50), (32 << 20, 4096)):  # many cells, some, one
        monkeypatch.setattr(topk, "SIDE_BYTES", size)
        monkeypatch.setattr(topk, "LEAST_SLICE", least)
        found = topk.top_k(table, F.col("vec_id") % 10 == 0, 5)
        assert sorted(map(tuple, found.collect())) == brute(kept, 10, 5)


def test_candidates_move_once_per_block_of_queries(spark, monkeypatch):
    """The plan's sequences give how often a row moves: 20 queries of 208 bytes, 400 candidates."""
    rows = [(i, [0.5] * 6, "", 0) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    for side, blocks, slices in ((32 << 20, 1, 1), (208 * 20, 1, 20), (208 * 5, 4, 80)):
        monkeypatch.setattr(topk, "SIDE_BYTES", side)
        plan = topk.top_k(table, F.col("vec_id") % 20 == 0, 5)._jdf.queryExecution().analyzed().toString()
        assert f"sequence(0, {blocks - 1}, " in plan and f"sequence(0, {slices - 1}, " in plan


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0], "", 0), (1, [2.0], "", 0)], SCHEMA)
    found = topk.top_k(table, F.col("vec_id") == 0, 5)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0, 5).count() == 0


def test_scores_beyond_32_and_64_bits(spark):
    big, huge = 1e6, 3e12
    table = spark.createDataFrame(
        [(0, [big, huge], "", 0), (1, [big, 0.0], "", 0), (2, [0.0, huge], "", 0)], "vec_id long, embedding array<double>, rank string, score int"
    )
    found = {r.vec_id: r.score for r in topk.top_k(table, F.col("vec_id") == 0, 5).collect()}
    assert found == {1: int(big * 256) ** 2, 2: topk.LIMIT}

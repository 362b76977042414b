import random

from criteria_engine.operators import metrics

CASES = {
    "none": ([], (0, 0, 0), (0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0)),
    "error": ([(1, None)], (1, 0, 1), (0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0)),
    "one each": ([(1, 1), (0, 0), (0, 1), (1, 0)], (4, 4, 0), (1, 1, 1, 1), (0.5,) * 4),
    "one class": ([(0, 0), (0, 0)], (2, 2, 0), (0, 2, 0, 0), (1.0, 0.0, 0.0, 0.0)),
    "other value": ([(1, 2), (1, 1)], (2, 2, 0), (1, 0, 0, 0), (0.5, 1.0, 1.0, 1.0)),
}


def numbers(row):
    return (
        (row.total, row.valid, row.errors),
        (row.tp, row.tn, row.fp, row.fn),
        (row.accuracy, row.precision, row.recall, row.f1),
    )


def test_cases(spark):
    for rows, *want in CASES.values():
        df = spark.createDataFrame(rows, "label int, prediction int")
        assert numbers(metrics.classification_metrics(df, by=()).first()) == tuple(want)


def test_per_model(spark):
    rows = [(name, *pair) for name, case in CASES.items() for pair in case[0]]
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    got = {r.model: numbers(r) for r in metrics.classification_metrics(df).collect()}
    assert got == {name: tuple(want) for name, (rows, *want) in CASES.items() if rows}


def test_ratios_are_bit_equal(spark):
    rng = random.Random(5)
    cells = {f"m{i}": [rng.randrange(40) for _ in range(4)] for i in range(150)}
    pairs = [(1, 1), (0, 0), (0, 1), (1, 0)]
    rows = [(m, *p) for m, counts in cells.items() for p, n in zip(pairs, counts) for _ in range(n)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    got = {r.model: r for r in metrics.classification_metrics(df).collect()}
    for model, (tp, tn, fp, fn) in cells.items():
        if not tp + tn + fp + fn:
            continue
        precision = tp / (tp + fp) if tp + fp else 0.0
        recall = tp / (tp + fn) if tp + fn else 0.0
        both = precision + recall
        assert got[model].accuracy == (tp + tn) / (tp + tn + fp + fn)
        assert (got[model].precision, got[model].recall) == (precision, recall)
        assert got[model].f1 == (2 * precision * recall / both if both else 0.0)


def test_comparison_keeps_models_without_results(spark):
    rows = [("qwen", 1, 1), ("qwen", 1, 2), ("qwen", 1, None), ("gpt4o", 1, None)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    got = [tuple(r) for r in metrics.compare_models(df).collect()]
    assert got == [
        (0, "gpt4o", 1, 0, 0, 0.0),
        (1, "gpt5", None, None, None, None),
        (2, "ministral", None, None, None, None),
        (3, "qwen", 3, 1, 1, 1.0),
    ]


def test_the_two_meanings_of_valid(spark):
    """Counts take any prediction for valid, the comparison only 0 and 1."""
    df = spark.createDataFrame([("qwen", 1, 2)], "model string, label int, prediction int")
    assert metrics.response_counts(df).first().valid == 1
    assert metrics.compare_models(df).collect()[3].valid == 0


def test_metrics_comparison_in_registry_order(spark):
    rows = [("qwen", 1, 1), ("gpt5", 0, 0)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int")
    assert [r.model for r in metrics.compare_metrics(df).collect()] == ["gpt5", "qwen"]


def test_rows_combine_before_the_shuffle(spark):
    df = spark.createDataFrame([("qwen", 1, 1)], "model string, label int, prediction int")
    plan = metrics.classification_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan

"""The model registry and its fan-out over rows."""

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from criteria_engine.fixed_values import MODELS


def select_models(names: str | None = None, registry=MODELS) -> tuple:
    """Registry entries for a comma list, in list order, repeats dropped; None for all."""
    if not names:
        return tuple(registry)
    known = dict(registry)
    chosen = list(dict.fromkeys(name.strip() for name in names.split(",")))
    for name in chosen:
        if name not in known:
            raise ValueError(f"unknown model {name!r}; known: {', '.join(known)}")
    return tuple((name, known[name]) for name in chosen)


def registry_table(spark: SparkSession, registry=MODELS) -> DataFrame:
    rows = [(i, name, model_id) for i, (name, model_id) in enumerate(registry)]
    return spark.createDataFrame(rows, "ord int, model string, model_id string")


def fan_out(rows: DataFrame, models=MODELS) -> DataFrame:
    """Every row once per model. The models sit in the plan, so nothing is joined or moved."""
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(m).alias("model"), F.lit(mid).alias("model_id"))
            for i, (m, mid) in enumerate(models)
        ]
    )
    return rows.select("*", F.inline(entries))


def model_id(models=MODELS, model="model") -> Column:
    """Provider id of a model name, from a literal map."""
    entries = F.create_map(*map(F.lit, chain.from_iterable(models)))
    return F.try_element_at(entries, F.col(model))

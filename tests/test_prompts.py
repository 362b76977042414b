import json

from criteria_engine.fixed_values import EXCLUSION_TEMPLATE, INCLUSION_TEMPLATE, SYSTEM_PROMPT
from criteria_engine.functions import prompts
from criteria_engine.operators.models import fan_out, model_id, registry_table, select_models

import pytest

ROWS = [
    ("INCL", "use {drug_name} {0} 100% \\", "A{criteria_text}"),
    ("incl", "a", "b"),
    ("EXCL", 'quote " and \n line', "c"),
    ("", "", ""),
    ("other", "x", "y"),
]


def table(spark):
    return spark.createDataFrame(ROWS, "section string, criteria_text string, drug_name string")


def filled(section, text, drug):
    template = INCLUSION_TEMPLATE if section.upper() == "INCL" else EXCLUSION_TEMPLATE
    return template.format(criteria_text=text, drug_name=drug)


def test_templates():
    for template in (INCLUSION_TEMPLATE, EXCLUSION_TEMPLATE):
        assert template.count("{criteria_text}") == 1
        assert template.count("{drug_name}") == 8


def test_prompts(spark):
    got = table(spark).select(prompts.user_prompt(), prompts.system_prompt()).collect()
    assert [r[0] for r in got] == [filled(*row) for row in ROWS]
    assert {r[1] for r in got} == {SYSTEM_PROMPT}


def test_preview(spark):
    got = table(spark).select(prompts.prompt_preview(prompts.user_prompt())).collect()
    assert [r[0] for r in got] == [filled(*row)[:200] + "..." for row in ROWS]


def test_payload(spark):
    wanted = fan_out(table(spark), select_models("qwen"))
    for row, got in zip(ROWS, wanted.select(prompts.request_payload()).collect()):
        assert json.loads(got[0]) == {
            "model": "qwen/qwen3-32b",
            "messages": [
                {"role": "system", "content": SYSTEM_PROMPT},
                {"role": "user", "content": filled(*row)},
            ],
            "temperature": 0.0,
            "max_tokens": 512,
        }


def test_model_selection():
    assert [name for name, _ in select_models()] == ["gpt4o", "gpt5", "ministral", "qwen"]
    assert [name for name, _ in select_models(" qwen,gpt5 ,qwen")] == ["qwen", "gpt5"]
    with pytest.raises(ValueError, match="nope"):
        select_models("gpt5,nope")


def test_fan_out_joins_nothing(spark):
    wanted = fan_out(table(spark))
    assert wanted.count() == 4 * len(ROWS)
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Exchange" not in plan
    assert registry_table(spark).count() == 4


def test_model_ids(spark):
    df = spark.createDataFrame([("qwen",), ("nope",)], "model string")
    assert [r[0] for r in df.select(model_id()).collect()] == ["qwen/qwen3-32b", None]

"""Column functions that render prompts and request bodies."""

import re

from pyspark.sql import Column, functions as F

from criteria_engine.fixed_values import (
    EXCLUSION_TEMPLATE,
    INCLUSION_TEMPLATE,
    MAX_TOKENS,
    SYSTEM_PROMPT,
    TEMPERATURE,
)


def section_route(section="section") -> Column:
    """'inclusion' for INCL in any case, 'exclusion' for everything else."""
    return F.when(F.upper(section) == "INCL", "inclusion").otherwise("exclusion")


def render(template: str) -> Column:
    """Fill a template's {column} placeholders in one pass, so braces in data stay."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    )


def system_prompt() -> Column:
    return F.lit(SYSTEM_PROMPT)


def user_prompt() -> Column:
    """Section-aware prompt from `section`, `criteria_text` and `drug_name`."""
    return F.when(section_route() == "inclusion", render(INCLUSION_TEMPLATE)).otherwise(
        render(EXCLUSION_TEMPLATE)
    )


def prompt_preview(prompt: Column, size: int = 200) -> Column:
    return F.concat(F.substring(prompt, 1, size), F.lit("..."))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def request_payload(model_id="model_id") -> Column:
    """Chat-completion request body as JSON, for a batch-request table."""
    messages = F.array(_message("system", system_prompt()), _message("user", user_prompt()))
    return F.to_json(
        F.struct(
            F.col(model_id).alias("model"),
            messages.alias("messages"),
            F.lit(TEMPERATURE).alias("temperature"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
        )
    )

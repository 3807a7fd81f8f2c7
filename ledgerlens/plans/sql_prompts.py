"""DuckDB twins of prompt formatting and budgets."""
from __future__ import annotations

from ..functions import prompts as P
from .templates import sql_literal


def render(template: str, problem: str) -> str:
    head, tail = template.split("{problem}")
    return f"({sql_literal(head)} || {problem} || {sql_literal(tail)})"


def inject(problem: str, tests: str) -> str:
    skip = f"(contains({problem}, {sql_literal(P.TEST_MARKER)}) OR contains({problem}, {sql_literal(P.ASSERT_MARKER)}))"
    return (f"(CASE WHEN coalesce(len({tests}) > 0, false) AND NOT {skip} THEN {problem} || "
            f"{sql_literal(chr(10) * 2 + P.TEST_MARKER + chr(10))} || array_to_string({tests}, chr(10)) ELSE {problem} END)")


def format_prompt(problem: str, et: str, tests: str) -> str:
    return (f"(CASE {et} WHEN 'code' THEN {render(P.CODE_PROMPT_TEMPLATE, inject(problem, tests))} "
            f"WHEN 'science' THEN {render(P.SCIENCE_PROMPT_TEMPLATE, problem)} "
            f"WHEN 'math' THEN {render(P.MATH_PROMPT_TEMPLATE, problem)} ELSE {problem} END)")


def estimate(text: str) -> str:
    return f"CAST(floor(floor(coalesce(length({text}), 0) / 4) * 1.7::DOUBLE) AS BIGINT)"


def budget(prompt: str, max_out: str, window: str) -> str:
    return (f"CAST(CASE WHEN {window} IS NOT NULL THEN greatest({window} - {estimate(prompt)} - {P.CONTEXT_BUFFER}, "
            f"{P.MIN_OUTPUT_BUDGET}) ELSE {max_out} END AS BIGINT)")

"""Prompt building, test-case injection and output budgets.

Templates are fixed values kept exactly as published (``{problem}`` included, since
their SHA-256 is part of a run's identity).  Rendering is literal concatenation,
never ``format_string``, so ``%`` or braces inside problem text are safe.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col
from .usage import estimate_tokens

# ---------------------------------------------------------------- fixed values
MATH_PROMPT_TEMPLATE = (
    "Solve the following math problem. Enclose your final answer strictly inside "
    "<answer> and </answer> tags at the very end of your response.\n\n"
    "Problem: {problem}"
)
CODE_PROMPT_TEMPLATE = (
    "Write a Python function to solve the following problem. "
    "Enclose your final executable Python code strictly inside "
    "<solution> and </solution> tags.\n\n"
    "Problem:\n{problem}"
)
SCIENCE_PROMPT_TEMPLATE = (
    "Answer the following multiple-choice question. "
    "Enclose your final chosen letter (A, B, C, or D) strictly inside "
    "<answer> and </answer> tags.\n\n"
    "Question:\n{problem}"
)
TEMPLATES = {"code": CODE_PROMPT_TEMPLATE, "science": SCIENCE_PROMPT_TEMPLATE, "math": MATH_PROMPT_TEMPLATE}
PROMPT_FORMATTER_VERSION = "1"
TEST_MARKER = "Your code must be able to pass these tests:"
ASSERT_MARKER = "assert "
LOADER_HINT = "\n\nYour code should pass these tests:\n"
LOADER_HINT_TESTS = 3
CONTEXT_BUFFER = 256
MIN_OUTPUT_BUDGET = 100
# ----------------------------------------------------------------------------


def _render(template: str, problem: Column) -> Column:
    head, tail = template.split("{problem}")
    return F.concat(F.lit(head), problem, F.lit(tail))


def inject_tests(problem, test_cases) -> Column:
    """Code prompts list every test unless the text already has the marker or an assert."""
    p, t = col(problem), col(test_cases)
    skip = p.contains(TEST_MARKER) | p.contains(ASSERT_MARKER)
    add = F.coalesce(F.size(t) > 0, F.lit(False)) & ~skip
    return F.when(add, F.concat(p, F.lit("\n\n" + TEST_MARKER + "\n"), F.array_join(t, "\n"))).otherwise(p)


def format_prompt(problem, evaluator_type, test_cases=None) -> Column:
    """The evaluator's template around the problem; unknown evaluators get the raw text."""
    p, et = col(problem), col(evaluator_type)
    code_problem = inject_tests(p, test_cases) if test_cases is not None else p
    return (F.when(et == "code", _render(CODE_PROMPT_TEMPLATE, code_problem))
            .when(et == "science", _render(SCIENCE_PROMPT_TEMPLATE, p))
            .when(et == "math", _render(MATH_PROMPT_TEMPLATE, p))
            .otherwise(p))


def loader_hint(text, test_list) -> Column:
    """First three tests appended, each indented two spaces, one per line."""
    t = col(test_list)
    tests = F.array_join(F.transform(F.slice(t, 1, LOADER_HINT_TESTS), lambda x: F.concat(F.lit("  "), x,
                                                                                          F.lit("\n"))), "")
    return F.when(F.coalesce(F.size(t) > 0, F.lit(False)),
                  F.concat(col(text), F.lit(LOADER_HINT), tests)).otherwise(col(text))


def merge_tests(test_cases, test_list, challenge_test_list) -> Column:
    """``test_cases`` when present, else ``test_list + challenge_test_list``."""
    empty = F.array().cast("array<string>")
    return F.coalesce(col(test_cases), F.concat(F.coalesce(col(test_list), empty),
                                                F.coalesce(col(challenge_test_list), empty)))


def output_budget(prompt, max_output_tokens, max_context_window, estimate: Column | None = None) -> Column:
    """Fixed budget, or ``max(window - estimate - 256, 100)`` in window mode."""
    est = estimate_tokens(prompt) if estimate is None else estimate
    window = col(max_context_window)
    return F.when(window.isNotNull(),
                  F.greatest(window - est - F.lit(CONTEXT_BUFFER), F.lit(MIN_OUTPUT_BUDGET).cast("bigint"))) \
        .otherwise(col(max_output_tokens)).cast("bigint")


def template_hash(evaluator_type: str) -> str:
    t = TEMPLATES.get(evaluator_type)
    return hashlib.sha256(t.encode("utf-8")).hexdigest() if t is not None else "raw"


def template_identity(evaluator_type) -> Column:
    """H6: evaluator name, formatter version and the template's SHA-256 (``raw`` if custom)."""
    et = col(evaluator_type)
    h = F.lit("raw")
    for name, tpl in TEMPLATES.items():
        h = F.when(et == name, F.sha2(F.lit(tpl), 256)).otherwise(h)
    return F.struct(et.alias("evaluator_type"), F.lit(PROMPT_FORMATTER_VERSION).alias("formatter_version"),
                    h.alias("template_hash"))

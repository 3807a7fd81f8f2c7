"""Extension registries (U1, U2, U4; U3 = verdict tables, U5 = run_scripts).

Graders and providers are table → table functions, not per-row objects: a grader
receives the responses DataFrame (with the problem columns joined in) and returns it
with ``correct``, ``extracted_answer`` and ``extraction_method`` added, so it can be
column expressions, a join or ``mapInPandas`` as it needs.  Registering a name twice
is refused; an unknown name fails listing the registered ones.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import extract as X
from .functions import usage as U

Grader = Callable[[DataFrame, dict], DataFrame]
_GRADERS: dict[str, Grader] = {}


def register_grader(name: str):
    """``@register_grader("name")`` on ``fn(responses_df, conf) -> graded_df``."""
    def deco(fn: Grader) -> Grader:
        if name in _GRADERS:
            raise ValueError(f"evaluator '{name}' is already registered")
        _GRADERS[name] = fn
        return fn
    return deco


def available_graders() -> list[str]:
    return sorted(_GRADERS)


def get_grader(name: str) -> Grader:
    if name not in _GRADERS:
        raise ValueError(f"unknown evaluator '{name}'. Registered evaluators: "
                         f"{', '.join(available_graders()) or '(none)'}")
    return _GRADERS[name]


def grade(df: DataFrame, evaluator_type: str, conf: dict | None = None) -> DataFrame:
    return get_grader(evaluator_type)(df, conf or {})


@register_grader("science")
def _science(df: DataFrame, conf: dict) -> DataFrame:
    resp, truth = conf.get("response", "response"), conf.get("truth", "truth")
    g = df.withColumn("_x", X.mcq_answer(resp))
    return g.withColumns({"extracted_answer": F.col("_x.answer"), "extraction_method": F.col("_x.method"),
                          "correct": X.mcq_correct("_x.answer", truth)}).drop("_x")


@register_grader("code")
def _code(df: DataFrame, conf: dict) -> DataFrame:
    """Every column goes through the runner with its row: as many rows come out as went in."""
    from .operators.code_exec import grade_code
    resp, tests = conf.get("response", "response"), conf.get("tests", "tests")
    g = df.withColumn("_x", X.code_answer(resp)).select(*df.columns, F.col("_x.answer").alias("extracted_answer"), F.col("_x.method").alias("extraction_method"))
    out = grade_code(g, g.columns, "extracted_answer", tests, timeout_s=conf.get("execution_timeout", 5))
    return out.withColumn("correct", F.col("all_passed"))


@register_grader("math")
def _math(df: DataFrame, conf: dict) -> DataFrame:
    """Needs ``conf["verdicts"]``: a table of judge outputs keyed like the responses."""
    from .operators.judge import verdict_grade
    if "verdicts" not in conf:
        raise ValueError("math scoring requires a table of judge verdicts (conf['verdicts'])")
    return verdict_grade(df, conf["verdicts"], conf["keys"], conf.get("response", "response"),
                         conf.get("content", "content"))


# ---------------------------------------------------------------- providers
@dataclass(frozen=True)
class Provider:
    """What a registered provider brings: its request body (Q1-Q4), the paths no override may
    touch (P21) and its usage normaliser over the parsed payload and the text (N9)."""

    name: str
    protected_paths: tuple[str, ...]
    normalize_usage: Callable[[Column, str], Column]
    build_request: Callable[..., Column]


_PROVIDERS: dict[str, Provider] = {}


def register_provider(p: Provider) -> Provider:
    if p.name in _PROVIDERS:
        raise ValueError(f"provider '{p.name}' is already registered")
    _PROVIDERS[p.name] = p
    return p


def providers() -> list[Provider]:
    return list(_PROVIDERS.values())


def available_providers() -> list[str]:
    return sorted(_PROVIDERS)


def get_provider(name: str) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider '{name}'. Registered providers: "
                         f"{', '.join(available_providers()) or '(none)'}")
    return _PROVIDERS[name]


def _builtin_providers() -> None:
    from .operators import runs as RU
    built = {
        U.CHAT: (U.chat_usage, RU.chat_request), U.RESPONSES: (U.responses_usage, RU.responses_request),
        U.GENERATE: (lambda u, text: U.generate_usage(u), RU.generate_request),
        U.MESSAGES: (lambda u, text: U.messages_usage(u["input_tokens"], u["output_tokens"], u["output_tokens_details"]["thinking_tokens"], text), RU.messages_request)}
    for name, (usage, request) in built.items():
        register_provider(Provider(name, RU.PROTECTED_PATHS[name], usage, request))


_builtin_providers()


# ---------------------------------------------------------------- token counters (U4)
TokenCounter = Callable[[Column], Column]  # text -> struct<n: bigint, estimated: boolean>
_COUNTERS: dict[str, TokenCounter] = {"estimate": U.default_token_count}


def register_token_counter(name: str, fn: TokenCounter) -> None:
    if name in _COUNTERS:
        raise ValueError(f"token counter '{name}' is already registered")
    _COUNTERS[name] = fn


def token_counter(name: str = "estimate") -> TokenCounter:
    if name not in _COUNTERS:
        raise ValueError(f"unknown token counter '{name}'. Registered: {', '.join(sorted(_COUNTERS))}")
    return _COUNTERS[name]

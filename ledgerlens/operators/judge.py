"""Judge prompts, judge-output parsing and verdict joins.

Live judge calls are out of scope: judge outputs are an input table
``(key..., content)``.  Parsing follows a fixed recovery order, all in column
expressions over Spark's VARIANT type:

1. strip; a leading code fence with at least one closing fence is unwrapped (and a
   ``json`` tag dropped);
2. the whole text as strict JSON (wrapped in ``[...]`` so trailing text is rejected);
   a non-object value is a failure;
3. the last ``{...}`` (shortest brace span) that parses strictly;
4. an unclosed object: ``correct`` / ``extracted_answer`` / ``reasoning`` recovered
   by pattern from the prefix;
5. otherwise a failure message showing the first 120 characters.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import math_candidate
from ..functions.text import col, lstrip_ws, py_repr, strip_ws
from ..plans.templates import render_spark

# ---------------------------------------------------------------- fixed values
JUDGE_PROMPT_TEMPLATE = """\
You are a math grader. Decide whether the student's answer matches the ground-truth answer.

## Problem
{QUESTION}

## Ground Truth Answer
{GROUND_TRUTH}

## Student's Answer
{CANDIDATE}

## Instructions
1. The answer is correct if it matches the ground truth numerically or semantically (e.g. "1/2" == "0.5", "two" == "2").
2. Ignore minor formatting differences (e.g. "42" vs "42.0", "$100" vs "100", surrounding prose).
3. If the student's answer still contains reasoning, identify the final answer within it.

## Response Format
Respond with ONLY a JSON object in this exact format:
{"correct": true/false, "extracted_answer": "the student's final answer", "reasoning": "brief explanation"}
"""
JSON_SPAN = r"(?s)\{.*?\}"
TRUNC_CORRECT = r'(?i)"correct"\s*:\s*("?(?:true|false)"?)'
TRUNC_EXTRACTED = r'"extracted_answer"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
TRUNC_REASONING = r'"reasoning"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)'
TRUNC_REASONING_CHARS = 500
TRUNC_MARK = " [truncated]"
HEAD_CHARS = 120
AFFIRMATIVE = ("true", "yes", "1")
EMPTY_RESPONSE_REASONING = "empty response: judged incorrect without invoking the LLM judge"
MISSING_VERDICT = "judge verdict missing"
# Python type names reported when the judge returns valid JSON that is not an object.
_PY_TYPE = (("ARRAY", "list"), ("OBJECT", "dict"), ("STRING", "str"), ("BOOLEAN", "bool"),
            ("VOID", "NoneType"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"))
# ----------------------------------------------------------------------------


def judge_prompt(question, ground_truth, candidate) -> Column:
    """Question, truth and candidate placed into the fixed grading template."""
    return render_spark(JUDGE_PROMPT_TEMPLATE, {
        "QUESTION": col(question), "GROUND_TRUTH": col(ground_truth).cast("string"),
        "CANDIDATE": col(candidate)})


#: The verdict's fields; read so, the last of repeated members counts and NaN is a value.
VERDICT_FIELDS = "array<struct<correct VARIANT, extracted_answer STRING, reasoning STRING>>"


def strict_json(c) -> Column:
    """One complete JSON value and nothing after it, else null (as VARIANT).

    An object that VARIANT refuses, for repeated members or NaN, is read by its verdict fields."""
    listed = F.concat(F.lit("["), col(c), F.lit("]"))
    v = F.try_parse_json(listed)
    fields = F.from_json(listed, VERDICT_FIELDS)
    lenient = F.when((F.size(fields) == 1) & lstrip_ws(c).startswith("{"), F.to_variant_object(F.element_at(fields, 1)))
    return F.when(v.isNull(), lenient).when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def _vtype(v) -> Column:
    return F.schema_of_variant(v)


def _is_object(v) -> Column:
    return F.coalesce(_vtype(v).startswith("OBJECT"), F.lit(False))


def _py_type_name(v) -> Column:
    t = _vtype(v)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, name in _PY_TYPE:
        out = out.when(t.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit("int"))


def unfence(content) -> Column:
    c0 = strip_ws(content)
    parts = F.split(c0, "```", -1)
    fenced = strip_ws(F.element_at(parts, 2))
    fenced = F.when(fenced.startswith("json"), strip_ws(F.regexp_replace(fenced, "^json", ""))).otherwise(fenced)
    return F.when(c0.startswith("```") & (F.size(parts) >= 3), fenced).otherwise(c0)


def coerce_correct(v) -> Column:
    """X14 over a VARIANT: real boolean; number equal to 1; string true/yes/1 (trimmed, any
    case); anything else (missing, null, objects, other strings) is false."""
    t = _vtype(v)
    num = t.startswith("BIGINT") | t.startswith("INT") | t.startswith("SMALLINT") | t.startswith("TINYINT") \
        | t.startswith("DECIMAL") | t.startswith("DOUBLE") | t.startswith("FLOAT")
    return F.coalesce(
        F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(num, F.try_variant_get(v, "$", "double") == F.lit(1.0))
        .when(t == "STRING", coerce_correct_text(F.try_variant_get(v, "$", "string"))),
        F.lit(False))


def coerce_correct_text(s) -> Column:
    return F.coalesce(F.lower(strip_ws(s)).isin(*AFFIRMATIVE), F.lit(False))


def _last_strict_span(c) -> Column:
    """Stage 3: the last ``{...}`` span (shortest brace span) that parses strictly."""
    spans = F.regexp_extract_all(c, F.lit(JSON_SPAN), F.lit(0))
    parsed_spans = F.filter(F.transform(spans, lambda m: strict_json(m)), lambda v: v.isNotNull())
    return F.try_element_at(parsed_spans, F.lit(-1))


def _stage(c, whole, span) -> Column:
    trunc_ok = lstrip_ws(c).startswith("{") & c.rlike(TRUNC_CORRECT)
    return (F.when(whole.isNotNull() & _is_object(whole), F.lit("whole"))
            .when(whole.isNotNull(), F.lit("not_object"))
            .when(span.isNotNull(), F.lit("span"))
            .when(trunc_ok, F.lit("truncated"))
            .otherwise(F.lit("failed")))


def _judgment(c, whole, span, stage) -> Column:
    """The verdict struct from the unfenced text, its two strict parses and the stage."""
    m_corr = F.regexp_extract(c, TRUNC_CORRECT, 1)
    ext_raw = F.when(c.rlike(TRUNC_EXTRACTED), F.regexp_extract(c, TRUNC_EXTRACTED, 1))
    ext_dec = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), ext_raw, F.lit('"'))), "$", "string")
    rea_raw = F.when(c.rlike(TRUNC_REASONING), F.regexp_extract(c, TRUNC_REASONING, 1))
    rea = F.concat(F.substring(rea_raw, 1, TRUNC_REASONING_CHARS), F.lit(TRUNC_MARK))
    head = F.substring(c, 1, HEAD_CHARS)
    fail_msg = F.concat(F.lit("JSONDecodeError: No JSON object found in judge response (head: "),
                        py_repr(head), F.lit("): line 1 column 1 (char 0)"))
    obj = F.when(whole.isNotNull(), whole).otherwise(span)

    def field(name):
        return F.try_variant_get(obj, f"$.{name}", "string")

    corr_v = F.try_variant_get(obj, "$.correct", "variant")
    correct = (F.when(stage.isin("whole", "span"), coerce_correct(corr_v))
               .when(stage == "truncated", coerce_correct_text(F.regexp_replace(m_corr, '^"+|"+$', "")))
               .otherwise(F.lit(False)))
    extracted = (F.when(stage.isin("whole", "span"), field("extracted_answer"))
                 .when(stage == "truncated", F.coalesce(ext_dec, ext_raw)))
    reasoning = (F.when(stage.isin("whole", "span"), F.coalesce(field("reasoning"), F.lit("")))
                 .when(stage == "truncated", F.coalesce(rea, F.lit("")))
                 .otherwise(F.lit("")))
    error = (F.when(stage == "not_object",
                    F.concat(F.lit("'"), _py_type_name(whole), F.lit("' object has no attribute 'get'")))
             .when(stage == "failed", fail_msg))
    return F.struct(correct.alias("correct"), extracted.alias("extracted_answer"),
                    reasoning.alias("reasoning"), error.alias("error"), stage.alias("stage"))


def parse_judgment(content) -> Column:
    """X13 + X14: struct<correct, extracted_answer, reasoning, error, stage>."""
    c = unfence(content)
    whole, span = strict_json(c), _last_strict_span(c)
    return _judgment(c, whole, span, _stage(c, whole, span))


def parse_judgment_frame(df: DataFrame, content: str, out: str = "judgment") -> DataFrame:
    """:func:`parse_judgment` as staged projections: the unfenced text, both strict parses
    and the stage are columns of their own, so Catalyst keeps one projection per stage
    instead of inlining each into every reference (the single expression is ~100x
    larger and too big for whole-stage code generation).  Adds struct ``out``."""
    s = df.withColumn("_jc", unfence(content))
    s = s.withColumns({"_jw": strict_json("_jc"), "_js": _last_strict_span(F.col("_jc"))})
    s = s.withColumn("_jst", _stage(F.col("_jc"), F.col("_jw"), F.col("_js")))
    s = s.withColumn(out, _judgment(F.col("_jc"), F.col("_jw"), F.col("_js"), F.col("_jst")))
    return s.drop("_jc", "_jw", "_js", "_jst")


def verdict_grade(candidates: DataFrame, verdicts: DataFrame, keys: Sequence[str],
                  response_col: str = "response", content_col: str = "content") -> DataFrame:
    """J6 + X11 + X15: grade math responses from a table of judge outputs.

    Blank responses never reach the judge (fixed incorrect grade).  Others are joined
    (left) to their judge output on ``keys``; a missing or unparseable verdict
    becomes an ``evaluator_error`` and the row stays re-judgable.
    """
    keys = list(keys)
    cands = candidates.withColumn("_c", math_candidate(response_col))
    judged = parse_judgment_frame(cands.join(verdicts.select(*keys, content_col), keys, "left"), content_col, "_v")
    judged = judged.withColumn("_v", F.when(F.col(content_col).isNotNull(), F.col("_v")))
    blank = ~F.col("_c.needs_judge")
    missing = F.col("_v").isNull()
    err = F.when(blank, F.lit(None).cast("string")).when(missing, F.lit(MISSING_VERDICT)) \
        .otherwise(F.col("_v.error"))
    return judged.select(
        *[c for c in candidates.columns],
        F.when(blank | missing, F.lit(False)).otherwise(F.col("_v.correct")).alias("correct"),
        F.when(blank, F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.col("_v.extracted_answer"), F.col("_c.block"))).alias("extracted_answer"),
        F.col("_c.method").alias("extraction_method"),
        F.when(blank, F.lit(EMPTY_RESPONSE_REASONING))
        .otherwise(F.coalesce(F.nullif(F.col("_v.reasoning"), F.lit("")), err)).alias("judge_reasoning"),
        err.alias("evaluator_error"))

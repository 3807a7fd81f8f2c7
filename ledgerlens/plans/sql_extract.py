"""DuckDB twins of the extraction cascades, generated from the same fixed patterns.

RE2 has no possessive quantifiers, no ``d``/``U`` flags and no Unicode ``\\s``, ``\\w``, ``\\b``; the
oracle spells these out as Unicode classes, so that it accepts the same text in any language.
"""
from __future__ import annotations

from ..functions.extract import (ANSWER_BLOCK, CODE_PATTERNS, CODE_START, FUNC_ANYWHERE, FUNC_LINE,
                                 MCQ_PATTERNS, MCQ_TAIL_CHARS, SCRIPT_IMPORTS, SCRIPT_RUNNER)
from .templates import sql_literal


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACE = r"\t\n\x0b\f\r\x{85}\p{Z}"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"


def uni(pattern: str) -> str:
    """``pattern`` with Unicode spaces and word characters, in and outside of brackets."""
    out, bracket, i = "", False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two in (r"\s", r"\w"):
            kind = _SPACE if two == r"\s" else _WORD
            out, i = out + (kind if bracket else f"[{kind}]"), i + 2
            continue
        if two[0] == "\\":
            out, i = out + two, i + 2
            continue
        if two[0] in "[]":
            bracket = two[0] == "["
        out, i = out + two[0], i + 1
    return out


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}\\x1c-\\x1f]+|[{_SPACE}\\x1c-\\x1f]+$', '', 'g')"


def last_letter(x: str) -> str:
    """The last letter A-D that stands alone: greedy up to it, so no word border is needed."""
    return f"nullif(regexp_extract({x}, '(?s)^(?:.*[^{_WORD}])?([A-Da-d])(?:[^{_WORD}].*)?$', 1), '')"


def blank(x: str) -> str:
    return "(" + strip("coalesce(" + x + ", '')") + " = '')"


def last(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({x}, {q(uni(pattern))}, {group})[-1]"


def answer_block(t: str) -> tuple[str, str]:
    content = f"nullif({strip(last(t, '(?is)' + ANSWER_BLOCK))}, '')"
    method = (f"CASE WHEN {blank(t)} THEN 'empty_response' WHEN {content} IS NOT NULL THEN 'answer_block' "
              f"ELSE 'no_answer_block' END")
    return f"CASE WHEN NOT {blank(t)} THEN {content} END", method


def mcq(t: str) -> tuple[str, str]:
    tail = f"right({t}, {MCQ_TAIL_CHARS})"
    arms = " ".join(f"WHEN regexp_matches({t}, {q('(?im)' + uni(p))}) THEN {q(n)}" for p, n in MCQ_PATTERNS)
    method = (f"CASE WHEN {blank(t)} THEN 'empty_response' {arms} "
              f"WHEN {last_letter(tail)} IS NOT NULL THEN 'fallback_letter' ELSE 'no_match' END")
    pick = " ".join(f"WHEN {q(n)} THEN upper({last(t, '(?im)' + p)})" for p, n in MCQ_PATTERNS)
    answer = f"CASE ({method}) {pick} WHEN 'fallback_letter' THEN upper({last_letter(tail)}) END"
    return answer, method


def mcq_correct(pred: str, truth: str) -> str:
    gt = f"upper({strip(f'CAST({truth} AS VARCHAR)')})"
    letter = f"nullif(regexp_extract({gt}, '([A-D])', 1), '')"
    return f"coalesce(upper({strip(pred)}) = coalesce({letter}, {gt}), false)"


def clean_code(code: str) -> str:
    kept = f"list_filter(string_split({code}, chr(10)), lambda l: NOT starts_with({strip('l')}, '```'))"
    flags = f"list_transform({kept}, lambda l: regexp_matches({strip('l')}, {q(uni(CODE_START))}))"
    start = f"coalesce(list_position({flags}, true), 0)"
    return f"CASE WHEN {start} > 0 THEN {strip(f'array_to_string(({kept})[{start}:], chr(10))')} END"


def function_fallback(t: str) -> str:
    lines = f"string_split({t}, chr(10))"
    st = f"coalesce(list_position(list_transform({lines}, lambda l: regexp_matches(l, {q(uni(FUNC_LINE))})), true), 0)"
    stops = (f"list_transform({lines}, lambda l, i: i > {st} AND NOT regexp_matches(l, {q(uni(FUNC_LINE))}) "
             f"AND {strip('l')} <> '' AND NOT starts_with(l, ' ') AND NOT starts_with(l, chr(9)))")
    sp = f"coalesce(list_position({stops}, true), 0)"
    body = f"CASE WHEN {sp} > 0 THEN ({lines})[{st}:{sp} - 1] ELSE ({lines})[{st}:] END"
    return (f"CASE WHEN regexp_matches({t}, {q(uni(FUNC_ANYWHERE))}) AND {st} > 0 "
            f"THEN {strip(f'array_to_string({body}, chr(10))')} END")


def code(t: str) -> tuple[str, str]:
    cands = [f"nullif({clean_code(strip(last(t, '(?' + fl + ')' + p.replace('*+', '*'))))}, '')"
             for p, _, fl in CODE_PATTERNS]
    fb = f"nullif({function_fallback(t)}, '')"
    answer = f"CASE WHEN NOT {blank(t)} THEN coalesce({', '.join(cands)}, {fb}) END"
    arms = " ".join(f"WHEN {c} IS NOT NULL THEN {q(n)}" for c, (_, n, _) in zip(cands, CODE_PATTERNS))
    method = (f"CASE WHEN {blank(t)} THEN 'empty_response' {arms} "
              f"WHEN {fb} IS NOT NULL THEN 'fallback_extraction' ELSE 'no_match' END")
    return answer, method


def py_repr(t: str) -> str:
    esc = f"replace(replace(replace(replace({t}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({t}, '''') AND NOT contains({t}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def test_script(code_col: str, tests: str) -> str:
    before, after = SCRIPT_RUNNER.split("{TESTS}")
    listed = f"array_to_string(list_transform({tests}, lambda t: {py_repr('t')}), ', ')"
    imports = "\n".join(SCRIPT_IMPORTS) + "\n"
    return f"{sql_literal(imports)} || {code_col} || {sql_literal(before)} || '[' || {listed} || ']' || {sql_literal(after)}"

"""DuckDB twin of judge-output parsing."""
from __future__ import annotations

from ..operators import judge as J
from .sql_extract import py_repr, q, strip


def _lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+', '')"


def parsed_cte(src: str = "judge_outputs", name: str = "judge_parsed") -> str:
    """``name`` has columns doc_id, stage, correct, extracted_answer, reasoning, error."""
    c0 = strip("content")
    fenced = strip(f"string_split({c0}, '```')[2]")
    unf = (f"CASE WHEN starts_with({c0}, '```') AND len(string_split({c0}, '```')) >= 3 THEN "
           f"(CASE WHEN starts_with({fenced}, 'json') THEN {strip(f'({fenced})[5:]')} ELSE {fenced} END) "
           f"ELSE {c0} END")
    trunc_corr = J.TRUNC_CORRECT
    ext = J.TRUNC_EXTRACTED.replace("*+", "*")
    rea = J.TRUNC_REASONING.replace("*+", "*")
    corr_t = "json_type(o, '$.correct')"
    corr_s = strip("json_extract_string(o, '$.correct')")
    m_corr = strip("regexp_replace(m_corr, '^\"+|\"+$', '', 'g')")
    coerce = (f"CASE WHEN {corr_t} = 'BOOLEAN' THEN CAST(json_extract(o, '$.correct') AS BOOLEAN) "
              f"WHEN {corr_t} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(json_extract(o, '$.correct') AS DOUBLE) = 1 "
              f"WHEN {corr_t} = 'VARCHAR' THEN lower({corr_s}) IN ('true', 'yes', '1') "
              f"ELSE false END")
    pytype = ("CASE whole_type WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' WHEN 'VARCHAR' THEN 'str' "
              "WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END")
    head = f"left(c, {J.HEAD_CHARS})"
    fail = (f"'JSONDecodeError: No JSON object found in judge response (head: ' || {py_repr(head)} "
            f"|| '): line 1 column 1 (char 0)'")
    return f"""{name} AS (
  SELECT doc_id, stage,
    CASE WHEN stage IN ('whole', 'span') THEN coalesce({coerce}, false)
         WHEN stage = 'truncated' THEN coalesce(lower({m_corr}) IN ('true', 'yes', '1'), false)
         ELSE false END AS correct,
    CASE WHEN stage IN ('whole', 'span') THEN json_extract_string(o, '$.extracted_answer')
         WHEN stage = 'truncated' THEN coalesce(CASE WHEN json_valid('"' || ext_raw || '"') THEN json_extract_string('"' || ext_raw || '"', '$') END, ext_raw) END AS extracted_answer,
    CASE WHEN stage IN ('whole', 'span') THEN coalesce(json_extract_string(o, '$.reasoning'), '')
         WHEN stage = 'truncated' THEN coalesce(left(rea_raw, {J.TRUNC_REASONING_CHARS}) || {q(J.TRUNC_MARK)}, '')
         ELSE '' END AS reasoning,
    CASE WHEN stage = 'not_object' THEN '''' || {pytype} || ''' object has no attribute ''get'''
         WHEN stage = 'failed' THEN {fail} END AS error
  FROM (
    SELECT *, CASE WHEN whole_ok AND whole_type = 'OBJECT' THEN 'whole' WHEN whole_ok THEN 'not_object'
                   WHEN span IS NOT NULL THEN 'span' WHEN trunc_ok THEN 'truncated' ELSE 'failed' END AS stage,
              CASE WHEN whole_ok THEN c ELSE span END AS o
    FROM (
      SELECT doc_id, c, json_valid(c) AS whole_ok, CASE WHEN json_valid(c) THEN json_type(c) END AS whole_type,
        list_filter(regexp_extract_all(c, {q(J.JSON_SPAN)}, 0), lambda m: json_valid(m))[-1] AS span,
        starts_with({_lstrip('c')}, '{{') AND regexp_matches(c, {q(trunc_corr)}) AS trunc_ok,
        regexp_extract(c, {q(trunc_corr)}, 1) AS m_corr,
        CASE WHEN regexp_matches(c, {q(ext)}) THEN regexp_extract(c, {q(ext)}, 1) END AS ext_raw,
        CASE WHEN regexp_matches(c, {q(rea)}) THEN regexp_extract(c, {q(rea)}, 1) END AS rea_raw
      FROM (SELECT doc_id, {unf} AS c FROM {src})))
)"""

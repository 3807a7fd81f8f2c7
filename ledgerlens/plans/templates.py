"""Text templates rendered identically as Spark columns and as DuckDB SQL.

A template is a string with ``{NAME}`` placeholders.  The fixture rules below use
one template list for both engines, so the Spark view and the oracle view cannot
drift apart.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PH = re.compile(r"\{([A-Z][A-Z0-9_]*)\}")


def _pieces(template: str):
    pos = 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            yield ("lit", template[pos:m.start()])
        yield ("var", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("lit", template[pos:])


def render_spark(template: str, values: dict[str, Column]) -> Column:
    parts = [F.lit(v) if kind == "lit" else values[v].cast("string") for kind, v in _pieces(template)]
    return F.concat(*parts) if parts else F.lit("")


def sql_literal(s: str) -> str:
    chunks = s.split("\n")
    quoted = ["'" + c.replace("'", "''") + "'" for c in chunks]
    return " || chr(10) || ".join(quoted)


def render_sql(template: str, values: dict[str, str]) -> str:
    parts = [sql_literal(v) if kind == "lit" else f"CAST(({values[v]}) AS VARCHAR)" for kind, v in _pieces(template)]
    return "(" + (" || ".join(parts) if parts else "''") + ")"


def case_spark(selector: Column, templates, values: dict[str, Column]) -> Column:
    out = None
    for i, t in enumerate(templates):
        out = (F.when(selector == i, render_spark(t, values)) if out is None
               else out.when(selector == i, render_spark(t, values)))
    return out


def case_sql(selector: str, templates, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {render_sql(t, values)}" for i, t in enumerate(templates))
    return f"CASE {selector} {arms} END"

"""JSON texts as rows (path, leaf) and back, in column expressions.

A path is an array of elements: a member's name as a JSON string, a list's index as digits.  A leaf is a scalar's JSON text, or ``{}`` or ``[]`` for an
empty container.  So every JSON text is a list of rows in document order, masking and overriding are filters on rows, and
the sorted rows are a canonical form.  Text is cut into tokens by one pattern; a fold over the tokens keeps the open containers.  These
are for configurations and requests' fixed parts, which are small: the fold copies what it has at each token.

A null text gives null; a text that is no JSON is told apart by ``is_json`` (lexically complete and balanced; repeated members and
``NaN`` count as JSON here, so that nothing in them escapes masking).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, col

_STRING = r'"(?:[^"\\]++|\\.)*+"'
TOKEN = _STRING + r"(?:\s*+:)?|-?(?:\d[\d.eE+\-]*+|Infinity)|true|false|null|NaN|[{}\[\],]"
ROWS = "array<struct<path:array<string>,leaf:string>>"
_STATE = f"struct<path:array<string>,kinds:string,fresh:boolean,out:{ROWS}>"


def tokens(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def is_json(text) -> Column:
    """Whether the text is a scalar, or containers that open and close, and nothing else."""
    t = tokens(text)
    rest = F.regexp_replace(col(text), TOKEN + r"|\s++", "")
    count = lambda mark: F.size(F.filter(t, lambda x: x == mark))
    container = F.get(t, F.lit(0)).isin("{", "[") & (count("{") == count("}")) & (count("[") == count("]"))
    return F.coalesce((rest == "") & (F.size(t) > 0) & (container | (F.size(t) == 1)), F.lit(False))


def string_of(token: Column) -> Column:
    """The text that a JSON string token stands for."""
    parsed = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    return F.when(token.contains("\\"), parsed).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def same_string(token: Column) -> Column:
    """A JSON string token in the form that ``token_of`` gives; without a backslash it has that form."""
    return F.when(token.contains("\\"), token_of(string_of(token))).otherwise(token)


def token_of(text: Column) -> Column:
    """The JSON string token of a text, always the same one."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def scalar(token: Column) -> Column:
    """One form for each scalar: strings with the same escapes, whole numbers as they are, others as doubles."""
    number = token.rlike(r"^-?\d")
    whole = token.rlike(r"^-?\d+$")
    return F.when(token.startswith('"'), same_string(token)).when(number & ~whole, token.try_cast("double").cast("string")).otherwise(token)


def json_rows(text) -> Column:
    """Rows of a JSON text, in document order."""
    def last(state):
        return F.size(state["path"]) - 1

    def with_last(path, value):
        return F.concat(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.array(value))

    def step(state, t):
        path, kinds, out = state["path"], state["kinds"], state["out"]
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        name = t.startswith('"') & t.endswith(":")
        kind = F.substring(kinds, -1, 1)
        outer = F.slice(path, F.lit(1), F.greatest(last(state), F.lit(0)))
        now = (F.when(opens, F.concat(path, F.array(F.when(t == "[", F.lit("0")).otherwise(F.lit("")))))
               .when(closes, outer)
               .when(t == ",", F.when(kind == "[", with_last(path, (F.try_element_at(path, F.lit(-1)).try_cast("int") + 1).cast("string"))).otherwise(path))
               .when(name, with_last(path, same_string(F.regexp_replace(t, r"\s*:$", ""))))
               .otherwise(path))
        kept = F.when(opens, F.concat(kinds, t)).when(closes, F.substring(kinds, F.lit(1), F.length(kinds) - 1)).otherwise(kinds)
        row = (F.when(closes & state["fresh"], F.array(F.struct(outer.alias("path"), F.concat(kind, t).alias("leaf"))))
               .when(~opens & ~closes & ~name & (t != ","), F.array(F.struct(path.alias("path"), scalar(t).alias("leaf")))))
        return bind(now, lambda now: F.struct(
            now.alias("path"), kept.alias("kinds"), opens.alias("fresh"),
            # of repeated members the last counts, with all that is below it
            F.when(row.isNotNull(), F.concat(out, row)).when(name, F.filter(out, lambda r: ~starts(r["path"], now))).otherwise(out).alias("out")).cast(_STATE))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("path"), F.lit("").alias("kinds"), F.lit(False).alias("fresh"), F.array().cast(ROWS).alias("out")).cast(_STATE)
    return F.when(col(text).isNotNull(), F.aggregate(tokens(text), start, step, lambda s: s["out"]))


def value_rows(text) -> Column:
    """Rows of an override's value: of its JSON, or of the text itself where that is no JSON."""
    c = col(text)
    plain = F.array(F.struct(F.array().cast("array<string>").alias("path"), token_of(c).alias("leaf"))).cast(ROWS)
    return F.when(is_json(c), json_rows(c)).otherwise(plain)


def is_name(element: Column) -> Column:
    return element.startswith('"')


def starts(path: Column, prefix: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix


def name_path(dotted) -> Column:
    """A dotted path as elements."""
    return F.transform(F.split(col(dotted), r"\."), token_of)


def below(rows: Column, prefix: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(F.concat(prefix, r["path"]).alias("path"), r["leaf"].alias("leaf"))).cast(ROWS)


def with_set(rows: Column, at: Column, value: Column) -> Column:
    """Rows with ``value`` (rows of its own) at a path: what was there goes, and so does what is on the way and no object."""
    def goes(r, at):
        n = F.least(F.size(r["path"]), F.size(at))
        same = F.slice(r["path"], F.lit(1), n) == F.slice(at, F.lit(1), n)
        shared = F.array_position(F.zip_with(F.slice(r["path"], F.lit(1), n), F.slice(at, F.lit(1), n), lambda a, b: a != b), F.lit(True))
        # the first element that differs is a list's index: the list is in the way
        return same | ((shared > 0) & ~is_name(F.get(r["path"], shared.cast("int") - 1)))
    return bind(at, lambda at: F.concat(F.filter(rows, lambda r: ~goes(r, at)), below(value, at)).cast(ROWS))


def without(rows: Column, at: Column) -> Column:
    """Rows without what is at a path of names; an object that loses its last member stays, empty."""
    def kept(at):
        outer = F.slice(at, F.lit(1), F.size(at) - 1)
        empty = F.array(F.struct(outer.alias("path"), F.lit("{}").alias("leaf"))).cast(ROWS)
        return bind(F.filter(rows, lambda r: ~starts(r["path"], at)), lambda left: F.when(
            (F.size(left) < F.size(rows)) & ~F.exists(left, lambda r: starts(r["path"], outer)), F.concat(left, empty)).otherwise(left).cast(ROWS))
    return bind(at, kept)


def masked(rows: Column, is_secret, mask: str) -> Column:
    """Rows in which each member with a secret name has the mask as its whole value."""
    def hide(r):
        at = F.array_position(F.transform(r["path"], lambda e: is_name(e) & is_secret(F.coalesce(string_of(e), e))), F.lit(True)).cast("int")
        return F.struct(F.when(at > 0, F.slice(r["path"], F.lit(1), at)).otherwise(r["path"]).alias("path"), F.when(at > 0, F.lit(f'"{mask}"')).otherwise(r["leaf"]).alias("leaf"))
    return F.array_distinct(F.transform(rows, hide)).cast(ROWS)


def in_order(rows: Column) -> Column:
    """Rows sorted by path: members by name, list items by index."""
    key = lambda r: F.transform(r["path"], lambda e: F.when(is_name(e), e).otherwise(F.lpad(e, 12, "0")))
    return F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(key(r).alias("k"), r.alias("r")))), lambda x: x["r"]).cast(ROWS)


def canonical(rows: Column) -> Column:
    """Sorted rows as texts ``path=leaf``, the same for equal values whatever their members' order."""
    return F.array_sort(F.transform(rows, lambda r: F.concat(F.array_join(r["path"], "/"), F.lit("="), r["leaf"])))


def json_text(rows: Column) -> Column:
    """The compact JSON text of rows whose containers' rows stand together (document order, or ``in_order``)."""
    def closing(path, beyond):
        own = F.slice(path, beyond + 1, F.greatest(F.size(path) - beyond, F.lit(0)))
        return F.array_join(F.transform(F.reverse(own), lambda e: F.when(is_name(e), F.lit("}")).otherwise(F.lit("]"))), "")

    def opening(path, beyond):
        own = F.slice(path, beyond + 1, F.greatest(F.size(path) - beyond, F.lit(0)))
        return F.array_join(F.transform(own, lambda e: F.when(is_name(e), F.concat(F.lit("{"), e, F.lit(":"))).otherwise(F.lit("["))), "")

    def whole(rows):
        def piece(r, i):
            before = F.get(rows, i - 1)["path"]
            n = F.greatest(F.array_position(F.zip_with(before, r["path"], lambda a, b: ~a.eqNullSafe(b)), F.lit(True)).cast("int"), F.lit(1))
            element = F.get(r["path"], n - 1)
            follows = F.concat(closing(before, n), F.lit(","), F.when(is_name(element), F.concat(element, F.lit(":"))).otherwise(F.lit("")), opening(r["path"], n))
            return F.concat(F.when(i == 0, opening(r["path"], F.lit(0))).otherwise(follows), r["leaf"])
        return F.concat(F.array_join(F.transform(rows, piece), ""), closing(F.try_element_at(rows, F.lit(-1))["path"], F.lit(0)))

    return bind(rows, whole)

"""JSON texts as rows, against Python's own reading of them."""
import json
import random

from pyspark.sql import functions as F

from ledgerlens.functions import json_rows as J
from ledgerlens.functions.redact import MASK, redact_json, redact_override_set

FIXED = ['{"a":1,"b":{"c":[1,2,{"d":null}],"e":{}},"f":[],"g":"x,\\"y{"}', "[]", "{}", "1", '"s"', "null", '[[1],[[]],{"a":[{"b":1},2]}]', '{"a": 1 , "b" :\n[ true,false ] }',
         '{"a":1.50,"b":1e3,"\\u00e9":"\\u00e9\\/\\n\\"\\\\"}', '{"a":{"x":1},"b":2,"a":{"y":3}}', '{"":{"0":1},"0":[1]}', '{"k":"日本 🙂","tokens":"token"}']
BROKEN = ["high", '{"a":1', "", " ", "1 2", "[1]]", '{"a":tru}', '"open', "{]"]


def _some(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.4:
        return r.choice([1, -2, 10**20, 0.5, 1e300, True, False, None, "", "x y", 'q"\\/', "é\n\x01", "[{,:", "secret"])
    if kind < 0.7:
        return [_some(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {r.choice(["a", "b", "key", "Token", "tokens", "a/b", 'q"', "", "0", "é"]): _some(r, depth + 1) for _ in range(r.randint(0, 4))}


def _masked(x):
    low = lambda k: k.lower()
    secret = lambda k: any(w in low(k) for w in ("key", "secret", "authorization", "password")) or ("token" in low(k) and "tokens" not in low(k))
    if isinstance(x, dict):
        return {k: MASK if secret(k) else _masked(v) for k, v in x.items()}
    return [_masked(v) for v in x] if isinstance(x, list) else x


def test_texts_come_back_and_are_masked(spark):
    r = random.Random(4)
    texts = FIXED + [json.dumps(_some(r), ensure_ascii=r.random() < 0.5, indent=r.choice((None, 1))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", J.is_json("t").alias("ok"), J.json_text(J.json_rows("t")).alias("back"), J.json_text(J.in_order(J.json_rows("t"))).alias("sorted"), redact_json("t").alias("masked")).collect()
    for x in rows:
        value = json.loads(x.t)
        assert x.ok and json.loads(x.back) == value and json.loads(x.sorted) == value and json.loads(x.masked) == _masked(value), x.t


def test_what_is_no_json_stays(spark):
    df = spark.createDataFrame([(t,) for t in [*BROKEN, None]], "t string")
    assert [(r.t, r.ok) for r in df.select(redact_json("t").alias("t"), J.is_json("t").alias("ok")).collect()] == [(t, False) for t in [*BROKEN, None]]


def test_canonical_rows_know_no_order_of_members(spark):
    pairs = [('{"a":1,"b":[{"x":"1","y":2}]}', '{"b":[{"y":2,"x":"1"}],"a":1}', True), ('{"a":"\\u00e9"}', '{"a":"é"}', True), ("[1,2]", "[2,1]", False), ('{"a":1}', '{"a":"1"}', False),
             ('{"0":1}', "[1]", False), ('{"a/b":1}', '{"a":{"b":1}}', False), ('{"a":{}}', '{"a":[]}', False), ('{"a":1.0}', '{"a":1.00}', True), ("{}", '{"a":{}}', False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.got == r.same for r in df.select("same", (J.canonical(J.json_rows("a")) == J.canonical(J.json_rows("b"))).alias("got")).collect())


def test_override_values_are_masked_without_python(spark):
    df = spark.createDataFrame([({"a.api_key": '{"x":1}', "b": '{"Password":[1],"keep":"k"}', "c": "high", "d.tokens": "5", "e": '{"token":1,"token":2}'},), ({},), (None,)], "m map<string,string>")
    out = df.select(redact_override_set("m").alias("m"))
    assert [r.m for r in out.collect()] == [{"a.api_key": f'"{MASK}"', "b": f'{{"Password":"{MASK}","keep":"k"}}', "c": "high", "d.tokens": "5", "e": f'{{"token":"{MASK}"}}'}, {}, None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_sets_and_unsets_on_rows(spark):
    def sent(base, sets, unset=()):
        df = spark.createDataFrame([(base,)], "t string")
        rows = J.json_rows("t")
        for path, value in sets:
            rows = J.with_set(rows, J.name_path(F.lit(path)), J.value_rows(F.lit(value)))
        for path in unset:
            rows = J.without(rows, J.name_path(F.lit(path)))
        return json.loads(df.select(J.json_text(J.in_order(rows))).first()[0])

    assert sent('{"l":[1,2]}', [("l.0", "5")]) == {"l": {"0": 5}}  # a list on the way is replaced
    assert sent('{"l":[1,2]}', [], ["l.0", "l.x"]) == {"l": [1, 2]}  # and never unset into
    assert sent('{"a":{}}', [("a.b", "[]")]) == {"a": {"b": []}}
    assert sent('{"a":1,"ab":2}', [("a", "high")], ["ab"]) == {"a": "high"}
    assert sent('{"a":1}', [], ["a"]) == {}
    assert sent('{"a":{"b":{"c":1}}}', [], ["a.b.c"]) == {"a": {"b": {}}}

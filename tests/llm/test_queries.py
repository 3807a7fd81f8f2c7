import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.queries import ORACLES, QUERIES
from ledgerlens.plans.verify import _rows

from ..conftest import SMALL
from .helpers import empty, frame


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, duck_con, name):
    df = QUERIES[name](spark, SMALL)
    res = duck_con.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, map(tuple, df.collect())) == _rows(columns, res.fetchall())


def test_all_operators_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES


def test_stages_follow_on_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert 200 > sizes[0] > sizes[1] >= sizes[2] > 100 and sizes[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    from ledgerlens.llm.packing import WordTokenizer, tokenizer_path
    rows = docs.collect()
    ids, _ = WordTokenizer(tokenizer_path())(pa.array([r["text"] for r in rows]))
    assert pieces.agg(F.sum("length")).first()[0] == len(ids) + len(rows)


def test_stages_on_odd_rows_and_on_none(spark):
    for df in (frame(spark), empty(spark)):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, df, SMALL)
            assert out.columns == df.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, SMALL).collect()

"""Sources and sinks: ledger open/identity refusal (S6), fail-fast problem scans."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import ledger_io as LIO
from ledgerlens.sources.problems import read_problems

from .test_runs import _run


def test_open_ledger_refuses_changed_identity(spark, tmp_path):
    path = str(tmp_path / "ledger")
    LIO.open_ledger(spark, path, _run(spark))          # creates the header
    LIO.open_ledger(spark, path, _run(spark, concurrency=99))  # same identity: resumable
    assert LIO.read_headers(spark, path).count() == 1
    with pytest.raises(ValueError, match="generation"):
        LIO.open_ledger(spark, path, _run(spark, temperature=0.7))


def test_problem_scan_keys_and_failfast(spark, tmp_path):
    good = tmp_path / "p.jsonl"
    good.write_text('{"problem": "a", "answer": 6, "id": 1}\n\n{"problem": "b", "answer": "6", "id": "1"}\n')
    rows = {r.problem_key: r for r in read_problems(spark, str(good)).collect()}
    assert set(rows) == {"1", '"1"'} and rows["1"].answer == "6" and rows['"1"'].answer == '"6"'
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"problem": "a", "answer": 6, "id": 1}\n{broken\n')
    with pytest.raises(Exception):
        read_problems(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        read_problems(spark, "")


def test_mbpp_routing(spark, tmp_path):
    p = tmp_path / "MBPP_small.jsonl"
    p.write_text('{"task_id": 7, "text": "add", "code": "def f(x): return x+1", '
                 '"test_list": ["assert f(1) == 2", "assert f(2) == 3", "assert f(3) == 4", "assert f(4) == 5"], '
                 '"challenge_test_list": ["assert f(9) == 10"]}\n')
    r = read_problems(spark, str(p)).collect()[0]
    assert r.problem_key == "7" and r.problem.endswith("  assert f(3) == 4\n")
    assert len(r.test_cases) == 5


def test_open_ledger_refuses_rows_without_header_and_raises_other_errors(spark, tmp_path):
    path = str(tmp_path / "bare")
    run = _run(spark)
    LIO.append_rows(run.select("run_id", "model"), path)
    with pytest.raises(ValueError, match="rows but no header"):
        LIO.open_ledger(spark, path, run)
    broken = tmp_path / "broken"
    (broken / "header").mkdir(parents=True)
    (broken / "header" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception) as e:
        LIO.open_ledger(spark, str(broken), run)
    assert not (broken / "header" / "log").exists() and "PATH_NOT_FOUND" not in str(e.value)


def test_appends_side_by_side_and_repeated_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("r", i) for i in range(10)], "run_id string, seq long")
    LIO.append_rows(rows, str(tmp_path), "stream-x-0")
    LIO.append_rows(rows, str(tmp_path), "stream-x-0")
    LIO.append_rows(rows, str(tmp_path))
    got = LIO.read_rows(spark, str(tmp_path))
    assert got.count() == 20 and set(got.columns) == {"run_id", "seq"}


def test_line_numbers_do_not_follow_the_splits(spark, tmp_path):
    from ledgerlens.sources.lines import numbered_lines
    p = tmp_path / "mbpp.jsonl"
    p.write_text("".join('{"text": "t%d", "code": "c"}\n' % i + ("\n" if i % 7 == 0 else "") for i in range(400)))
    keys = []
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "1000", "333"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            keys.append(sorted((r.problem, r.problem_key) for r in read_problems(spark, str(p)).collect()))
            lines = p.read_text().split("\n")[:-1]
            assert {r.line: r.value for r in numbered_lines(spark, str(p)).collect()} == {i: x for i, x in enumerate(lines, 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert keys[0] == keys[1] == keys[2] and len({k for _, k in keys[0]}) == 400


def test_plain_ledger_lines_take_run_and_place_from_the_file(spark, tmp_path):
    (tmp_path / "run7.jsonl").write_text('{"problem_id": "p", "correct": false}\nbroken\n{"problem_id": "p", "correct": true}\n')
    got = sorted((r.run_id, r.seq, r.correct) for r in LIO.read_ledger_json(spark, str(tmp_path / "run7.jsonl")).collect())
    assert got == [("run7", 1, False), ("run7", 3, True)]


def test_result_documents_of_the_reference(spark, tmp_path):
    import json
    config = {"dataset_path": "d.jsonl", "provider": "p", "model": "m", "reasoning_effort": "high", "enable_thinking": True}
    summary = {"total_problems": 2, "correct_count": 1, "accuracy": 50.0, "total_tokens": 9, "error_count": 0, "ock_score": 4.5}
    results = [{"problem_id": i, "question": "q\n", "ground_truth": "1", "model_response": "r", "correct": c,
                "tokens": {"prompt_tokens": 1, "answer_tokens": 2, "total_tokens": 3}, "latency": 1.5} for i, c in ((7, True), ("7", False))]
    doc = {"schema_version": "1", "config": config, "results": results, "summary": summary, "timestamp": "t", "dataset_name": "d"}

    def read(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=2) if isinstance(doc, dict) else doc)
        return LIO.read_result_documents(spark, str(tmp_path / name))

    df = read("whole.json", doc)
    rows = sorted(df.collect(), key=lambda r: r.position)
    assert [(r.problem_id.toJson(), r.correct, r.tokens.total_tokens, r.provider, r.model, r.summary.accuracy) for r in rows] == [
        ("7", True, 3, "p", "m", 50.0), ('"7"', False, 3, "p", "m", 50.0)]
    assert not {"reasoning_effort", "enable_thinking"} & set(df.columns) and rows[0].document.endswith("whole.json")
    assert read("empty.json", doc | {"results": []}).count() == 0
    for i, lack in enumerate([{"config": {k: v for k, v in config.items() if k != "provider"}}, {"dataset_name": None}, {"results": None}]):
        for results in (doc["results"], []):
            with pytest.raises(Exception, match="result document lacks"):
                read(f"lack{i}{len(results)}.json", doc | {"results": results} | lack).count()
    with pytest.raises(Exception):
        read("broken.json", '{"config": ').collect()


def test_run_ids_are_texts(spark, tmp_path):
    rows = spark.createDataFrame([(r, i) for i, r in enumerate(("01", "1", "1.0", "007", "7", "2024-01-01", "a/b c", "1"))], "run_id string, seq long")
    LIO.append_rows(rows, str(tmp_path))
    got = LIO.read_rows(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("run_id", "seq").collect())) == sorted(map(tuple, rows.collect()))
    one = got.where("run_id = '1'")
    assert one.count() == 2 and "run_id" in str(one._jdf.queryExecution().executedPlan()).split("PartitionFilters")[1][:80]


def test_two_openers_with_different_configurations(spark, tmp_path, monkeypatch):
    from ledgerlens.sources import files
    path, first = str(tmp_path), _run(spark)
    other = first.withColumn("model", F.lit("other"))
    create, tried = files.create, []

    def late(spark, name, text):  # just before the first opener's entry, a second one opens with another configuration
        if not tried:
            tried.append(name)
            LIO.open_ledger(spark, path, other)
        return create(spark, name, text)

    monkeypatch.setattr(files, "create", late)
    with pytest.raises(ValueError, match="different configuration"):
        LIO.open_ledger(spark, path, first)
    assert [r["run_id"] for r in LIO.read_headers(spark, path).collect()] == ["r"]
    LIO.open_ledger(spark, path, other)  # resumed: nothing is added
    assert len([n for n in (tmp_path / "header" / "log").iterdir()]) == 1 and len(list((tmp_path / "header").glob("data-*"))) == 1


def test_folders_of_a_ledger_do_not_grow_with_its_runs(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('r', id) run_id", "id seq")
    old = rows.where("seq < 3").withColumn("run_id", F.format_string("0%s", F.col("seq").cast("string"))).withColumn("arrival", F.lit("append-0"))
    old.write.partitionBy("run_id", "arrival").parquet(str(tmp_path / "rows"))  # as ledgers were before
    LIO.append_rows(rows, str(tmp_path), "a")
    LIO.append_rows(rows, str(tmp_path), "a")
    assert len([p for p in (tmp_path / "rows").iterdir() if p.is_dir()]) <= LIO.RUN_BUCKETS + 3
    got = sorted((r.run_id, r.seq) for r in LIO.read_rows(spark, str(tmp_path)).collect())
    assert got == sorted([(f"r{i}", i) for i in range(600)] + [(f"0{i}", i) for i in range(3)])


def test_groups_of_lines_are_worked_out_once_a_block(spark, tmp_path):
    from ledgerlens.sources.lines import numbered_lines
    (tmp_path / "run7.jsonl").write_text("a\nb\n")
    got = numbered_lines(spark, str(tmp_path / "run7.jsonl"), F.regexp_extract("file", LIO.RUN_OF_FILE, 1))
    assert sorted((r.value, r.group, r.line) for r in got.collect()) == [("a", "run7", 1), ("b", "run7", 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1  # not in each row of both scans

"""Incremental run summaries from latest-attempt deltas."""
import json

from ledgerlens.streaming import ledger_stream as LS


def _attempt(problem, seq, correct, tokens, error=None):
    return {"run_id": "r", "problem_key": problem, "seq": seq, "correct": correct, "prompt_tokens": 1,
            "answer_tokens": tokens - 1, "reasoning_tokens": 0, "output_tokens": tokens - 1,
            "total_tokens": tokens, "latency": 1.5, "error": error, "model_response": "x",
            "extraction_method": "answer_block"}


def test_live_summary_replaces_latest_and_ignores_older(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    arrivals = [
        [_attempt("p1", 1, False, 10, error="HTTP 500"), _attempt("p2", 2, True, 20)],
        [_attempt("p1", 5, True, 30)],          # newer attempt replaces p1's latest
        [_attempt("p1", 3, False, 99)],         # older attempt arriving late: ignored
    ]
    for i, rows in enumerate(arrivals):
        (src / f"part-{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = tmp_path / "summary"
    LS.live_summary(spark, str(src), str(out), str(tmp_path / "ckpt"), files_per_trigger=1).awaitTermination()
    s = LS.read_summary(spark, str(out)).collect()[0]
    assert (s.total_problems, s.correct_count, s.error_count) == (2, 2, 0)
    assert s.total_tokens == 50 and s.avg_tokens_per_problem == 25.0
    assert s.accuracy == 100.0 and s.batch_id == 2


def test_latest_rows_and_sums_are_merged(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(5):
        (src / f"part-{i}.json").write_text(json.dumps(_attempt("p%d" % (i % 2), i, True, 10 + i)) + "\n")
    out = tmp_path / "summary"
    LS.live_summary(spark, str(src), str(out), str(tmp_path / "ckpt"), files_per_trigger=1).awaitTermination()
    s = LS.read_summary(spark, str(out)).collect()[0]
    assert (s.total_problems, s.total_tokens) == (2, 13 + 14)
    version = LS.latest_version(spark, str(out))
    assert [f[:2] for f in version["sums"]] == ["1-", "0-"] and all(len(x) < LS.FOLDERS for x in version["buckets"].values())


def test_a_summary_reads_the_buckets_of_its_problems_and_not_the_history(spark, tmp_path):
    import random
    r, latest, held = random.Random(2), LS.Latest(spark, str(tmp_path / "s"), bucket_rows=40), {}

    def trigger(n, rows):
        for x in rows:
            key = (x["run_id"], x["problem_key"])
            if key not in held or held[key]["seq"] < x["seq"]:
                held[key] = x
        latest.add(spark.createDataFrame([tuple(x.get(c.split(" ")[0]) for c in LS.ATTEMPT_SCHEMA.split(", ")) for x in rows], LS.ATTEMPT_SCHEMA), n)
        got = {s["run_id"]: (s["total_problems"], s["correct_count"], s["total_tokens"], s["error_count"], s["avg_latency"]) for s in LS.read_summary(spark, str(tmp_path / "s")).collect()}
        want = {}
        for run in {k[0] for k in held}:
            own = [x for k, x in held.items() if k[0] == run]
            want[run] = (len(own), sum(x["correct"] for x in own), sum(x["total_tokens"] for x in own), sum(x["error"] is not None for x in own), round(sum(x["latency"] for x in own) / len(own), 6))
        assert got == want
        return latest.version

    def some(n, of):
        return [{**_attempt(f"p{r.randrange(of)}", 0, r.random() < 0.5, r.randint(1, 99), r.choice((None, "HTTP 500"))), "run_id": r.choice(("01", "1", "1.0")), "latency": r.randint(1, 10**6) / 1000} for _ in range(n)]

    seq = 0
    for n in range(6):
        rows = some(150, 400)
        for x in rows:
            seq += 1
            x["seq"] = seq - r.choice((0, 0, 0, 120))  # some arrive late
        r.shuffle(rows)
        seen = set()
        trigger(n, [x for x in rows if (k := (x["run_id"], x["problem_key"], x["seq"])) not in seen and not seen.add(k)])
    assert latest.version["n"] >= 8
    one = trigger(6, [{**_attempt("p5", 10_000, True, 7), "run_id": "01"}])
    assert one["read"] <= 4 * 40 < 300 < sum(sum(x.values()) for x in one["buckets"].values())
    trigger(6, [])  # the same trigger again, and one without rows
    trigger(7, [])


def _lines(texts, end="data: [DONE]"):
    chunk = 'data: {"id": "c", "model": "m", "choices": [{"index": 0, "delta": {"content": "%s"}, "finish_reason": null}]}'
    return [chunk % t for t in texts] + ([end] if end else [])


def test_requests_come_once_and_in_order(spark, tmp_path):
    from ledgerlens.streaming import assemble as A
    src, n = tmp_path / "src", [0]
    src.mkdir()

    def arrive(*rows):
        n[0] += 1
        (src / f"{n[0]}.json").write_text("".join(json.dumps({"request_id": r, "seq": s, "line": x, "ts": t}) + "\n" for r, s, x, t in rows))
        lines = spark.readStream.schema("request_id STRING, seq LONG, line STRING, ts TIMESTAMP").json(str(src))
        (A.assemble(lines, "chat", read_timeout_ms=60_000, lateness="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())

    x = _lines(["a", "b"])
    arrive(("swapped", 2, x[1], "2024-01-01 00:00:01"), ("early end", 3, x[2], "2024-01-01 00:00:01"), ("silent", 1, x[0], "2024-01-01 00:00:01"))
    arrive(("swapped", 1, x[0], "2024-01-01 00:00:02"), ("early end", 1, x[0], "2024-01-01 00:00:02"), ("early end", 2, x[1], "2024-01-01 00:00:02"))
    arrive((None, None, None, "2024-01-01 00:05:00"))
    arrive((None, None, None, "2024-01-01 00:05:01"))
    arrive(("silent", 2, x[1], "2024-01-01 00:06:00"))
    arrive((None, None, None, "2024-01-01 00:09:00"))
    arrive((None, None, None, "2024-01-01 00:09:01"))
    held = spark.read.schema(A.HELD).parquet(str(tmp_path / "out"))
    got = {r["request_id"]: r["text"] for r in A.responses(held, "chat").collect()}
    assert got == {"swapped": "ab", "early end": "ab", "silent": "a"}
    assert {r["request_id"] for r in held.where("timed_out").collect()} == {"swapped", "silent"}


def test_lines_of_a_hot_request_are_not_held_in_state(spark, tmp_path):
    import random
    from ledgerlens.streaming import assemble as A
    src, rnd = tmp_path / "src", random.Random(1)
    src.mkdir()
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2000)) for _ in range(1500)]
    rows = [("hot", i, x) for i, x in enumerate(_lines(texts))] + [("small", i, x) for i, x in enumerate(_lines(["a", "b"]))]

    def arrive(n, rows):
        (src / f"{n}.json").write_text("".join(json.dumps({"request_id": r, "seq": s, "line": x, "ts": t}) + "\n" for r, s, x, t in rows))
        lines = spark.readStream.schema("request_id STRING, seq LONG, line STRING, ts TIMESTAMP").json(str(src))
        (A.assemble(lines, "chat", read_timeout_ms=60_000, lateness="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())

    def responses():
        held = spark.read.schema(A.HELD).parquet(str(tmp_path / "out"))
        return {r["request_id"]: r["text"] for r in A.responses(held, "chat").collect()}

    arrive(1, [(r, s, x, "2024-01-01 00:00:01") for r, s, x in rows if s % 2])
    arrive(2, [(r, s, x, "2024-01-01 00:00:02") for r, s, x in rows if s % 2 == 0])
    state = sum(p.stat().st_size for p in (tmp_path / "ckpt" / "state").rglob("*") if p.is_file())
    assert state < 100_000 < sum(map(len, texts))
    assert responses() == {}
    arrive(3, [(None, None, None, "2024-01-01 00:05:00")])
    arrive(4, [(None, None, None, "2024-01-01 00:05:01")])
    want = {"hot": "".join(texts), "small": "ab"}
    assert responses() == want
    # too late; then the marker goes, and a further request of the same id stays open
    arrive(5, [("small", 0, _lines(["late"])[0], "2024-01-01 00:06:00")])
    assert responses() == want
    arrive(6, [(None, None, None, "2024-01-01 00:30:00")])
    arrive(7, [(None, None, None, "2024-01-01 00:30:01")])
    arrive(8, [("small", 3, _lines(["again"])[0], "2024-01-01 00:31:00")])
    assert responses() == want


# --- responses written while the stream runs --------------------------------------------------

class _Feed:
    """A source folder, and a stream on it that is run until so many responses are out."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options, self.n = spark, tmp_path, {"read_timeout_ms": 2_000, "grace_ms": 500, "buckets": 4, **options}, 0
        (tmp_path / "src").mkdir()

    def put(self, *rows):
        self.n += 1
        (self.path / "src" / f"{self.n:04d}.json").write_text("".join(json.dumps({"request_id": r, "seq": s, "line": x, "ts": "2024-01-01 00:00:00"}) + "\n" for r, s, x in rows))

    def run(self, total):
        from ledgerlens.streaming import completion as K
        lines = self.spark.readStream.schema("request_id STRING, seq LONG, line STRING, ts TIMESTAMP").option("maxFilesPerTrigger", 1).json(str(self.path / "src"))
        query, store = K.start(lines, str(self.path / "out"), str(self.path / "ckpt"), "chat", interval="0 seconds", **self.options)
        K.run_until(query, store, total, 120)
        self.store = store
        return {r["request_id"]: r for r in K.responses(self.spark, str(self.path / "out")).collect()}


def test_responses_come_once_while_others_run(spark, tmp_path):
    feed = _Feed(spark, tmp_path, read_timeout_ms=600_000, marker_ms=600_000)
    x = _lines(["a", "b"])
    feed.put(("swapped", 2, x[2]), ("open", 0, x[0]), (None, 1, x[0]))
    feed.put(("swapped", 1, x[1]), ("swapped", 0, x[0]))
    got = feed.run(1)
    assert {k: (r["text"], r["kind"], r["retryable"]) for k, r in got.items()} == {"swapped": ("ab", "ended", False)}
    # the stream goes on from its checkpoint: a late line is ignored, the open request ends
    feed.put(("swapped", 3, x[0]), ("open", 1, x[1]))
    feed.put(("open", 2, x[2]))
    got = feed.run(2)
    assert {k: r["text"] for k, r in got.items()} == {"swapped": "ab", "open": "ab"}
    assert len(list((tmp_path / "out" / "responses").iterdir())) == 2  # each was written by a trigger of its own


def test_an_attempt_beyond_its_limit_fails_while_others_run(spark, tmp_path):
    feed = _Feed(spark, tmp_path, read_timeout_ms=600_000, limit_ms=1_500)
    x = _lines(["a", "b"])
    feed.put(("slow", 0, x[0]), ("ends", 0, x[0]), ("ends", 1, x[1]), ("ends", 2, x[2]))
    feed.put(("slow", 1, x[1]))
    got = feed.run(2)
    slow = got["slow"]
    assert (slow["kind"], slow["text"], slow["error"], slow["total_tokens"], slow["retryable"]) == ("limit", "", "wall_clock_timeout: attempt exceeded 1.5s", 0, True)
    assert (got["ends"]["kind"], got["ends"]["text"]) == ("ended", "ab")


def test_a_trigger_reads_its_own_buckets_and_not_the_history(spark, tmp_path):
    from ledgerlens.streaming import completion as K
    store, x = K.Store(spark, str(tmp_path / "out"), "chat", buckets=16), _lines(["a" * 50] * 20)

    def trigger(n, lines, marks=()):
        rows = [(r, s, line, n, None, None, None) for r, s, line in lines] + [(r, None, None, None, kind, first, last) for r, kind, first, last in marks]
        store.add(spark.createDataFrame(rows, "request_id string, seq long, line string, arrived long, kind string, first_arrived long, last_arrived long"), n)
        return store.version

    for n in range(5):  # a history of requests that are over
        trigger(n, [(f"r{n}-{k}", s, line) for k in range(8) for s, line in enumerate(x)], [(f"r{n}-{k}", K.ENDED, n, n) for k in range(8)])
    early, late = json.loads(sorted((tmp_path / "out" / "version").glob("*.json"))[1].read_text()), store.version
    assert late["total"] == 40 and late["read"] <= 1.3 * early["read"] and late["written"] <= 1.3 * early["written"]
    assert store._rows(late["buckets"], late["buckets"]) <= 8 * len(x)  # hardly any line is kept
    one = trigger(5, [("own", s, line) for s, line in enumerate(x)], [("own", K.ENDED, 5, 5)])
    assert one["read"] <= 4 * len(x)
    assert trigger(5, [("own", 0, x[0])])["total"] == 41  # the same trigger again changes nothing
    # a late line is known as such, and goes with the others
    trigger(6, [("own", 21, x[0])], [("own", K.LATE, 6, 6)])
    trigger(7, [("open", 0, x[0])])
    held = store._lines(spark, store.version["buckets"], list(store.version["buckets"])).select("request_id").distinct().collect()
    assert [r[0] for r in held] == ["open"]
    assert K.responses(spark, str(tmp_path / "out")).count() == 41
    assert len(list((tmp_path / "out" / "arrivals").iterdir())) <= 2  # superseded folders are deleted


def test_two_writers_of_one_name(spark, tmp_path):
    from ledgerlens.sources import files
    path = str(tmp_path / "folder" / "x.json")
    assert files.create(spark, path, "one") and not files.create(spark, path, "two")
    assert files.read_text(spark, path) == "one" and files.names(spark, str(tmp_path / "folder")) == ["x.json"]
    files.remove(spark, path)
    assert files.names(spark, str(tmp_path / "none")) == [] and files.create(spark, path, "é")
    assert files.read_text(spark, path) == "é"


def test_a_stream_without_gaps_between_triggers_is_stopped(spark, tmp_path):
    import threading
    import time
    from types import SimpleNamespace
    import pytest
    from ledgerlens.streaming import completion as K
    store = K.Store(spark, str(tmp_path / "out"), "chat", buckets=2)
    batch = spark.createDataFrame([("r", 0, _lines(["a"])[0], 0, None, None, None)], f"{K.HELD.split(', first')[0]}, kind string, first_arrived long, last_arrived long")

    class Busy:  # a query whose triggers follow each other at once
        isActive, status, exception = True, {"isTriggerActive": True}, staticmethod(lambda: None)
        lastProgress = property(lambda self: SimpleNamespace(batchId=store.version["batch"]))

        def stop(self):
            self.isActive = False

    began, query = time.monotonic(), Busy()
    store.version["total"] = 1
    stopping = threading.Thread(target=K.run_until, args=(query, store, 1, 60))
    stopping.start()
    stopping.join(20)
    query.isActive = False
    assert not stopping.is_alive() and time.monotonic() - began < 20
    with pytest.raises(RuntimeError, match="closed"):  # not taken, so it isn't lost either
        store.add(batch, 0)
    again = K.Store(spark, str(tmp_path / "out"), "chat", buckets=2)
    again.add(batch, 0)
    assert again.version["batch"] == 0


def test_a_task_hands_on_one_row_a_request_however_its_lines_are_dealt():
    import pyarrow as pa
    from ledgerlens.streaming import assemble as A

    def batch(ids, ends, arrived):
        return pa.record_batch({"request_id": pa.array(ids, pa.string()), "ts": pa.array([None] * len(ids), pa.timestamp("us")), "ends": ends, "arrived": arrived})

    batches = [batch(["a", "b", None], [False, False, False], [1, 1, 1]), batch(["b", "a"], [True, False], [2, 2]), batch([], pa.array([], pa.bool_()), pa.array([], pa.int64())),
               batch(["c", "a", None], [False, False, False], [3, 3, 3])]
    want = {"a": (False, 3), "b": (True, 2), "c": (False, 3), None: (False, 3)}
    rows = [r for b in A._combine(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 4 and {r["request_id"]: (r["ends"], r["arrived"]) for r in rows} == want
    # with less room there are more rows, which say the same
    rows = [r for b in A._combine(iter(batches), 4) for r in b.to_pylist()]
    assert {k: (any(r["ends"] for r in rows if r["request_id"] == k), max(r["arrived"] for r in rows if r["request_id"] == k)) for k in want} == want
    assert list(A._combine(iter([]))) == []


def test_a_stream_that_goes_on_is_not_given_up(spark, tmp_path):
    import time
    from types import SimpleNamespace
    from ledgerlens.streaming import completion as K
    store, began = K.Store(spark, str(tmp_path / "out"), "chat", buckets=2), time.monotonic()

    class Query:  # a trigger with lines every half a second, the responses after three seconds
        status, exception = {"isTriggerActive": True}, staticmethod(lambda: None)
        lastProgress = property(lambda self: SimpleNamespace(batchId=store.version["batch"]))

        @property
        def isActive(self):
            passed = time.monotonic() - began
            store.version = {**store.version, "batch": int(passed * 2), "written": 1, "total": int(passed > 3)}
            return passed < 20

        def stop(self):
            pass

    K.run_until(Query(), store, 1, seconds=1.5)
    assert store.version["total"] == 1


class _State:
    """A handle whose states are kept in Python; ``calls`` counts the calls, each of which is a round trip in a stream."""

    def __init__(self):
        self.calls, self.timers, self.held = 0, set(), {}

    def _named(self, name):
        from types import SimpleNamespace

        def counted(f):
            def call(*args):
                self.calls += 1
                return f(*args)
            return call

        return SimpleNamespace(get=counted(lambda: self.held.get(name, None if name == "next" else [])), put=counted(lambda x: self.held.update({name: list(x)})),
                               update=counted(lambda x: self.held.update({name: x})), clear=counted(lambda: self.held.pop(name, None)),
                               appendList=counted(lambda x: self.held.update({name: [*self.held.get(name, []), *x]})))

    def getListState(self, name, schema, ttlDurationMs=None):
        return self._named(name)

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self._named(name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_the_state_is_called_once_for_a_group_of_requests():
    from types import SimpleNamespace
    from ledgerlens.streaming import completion as K
    handle, lives = _State(), K.Requests(read_timeout_ms=10_000, grace_ms=1_000, marker_ms=60_000, limit_ms=5_000)
    lives.init(handle)

    def trigger(now, rows=()):
        times = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        out = list(lives.handleInputRows((7,), iter([SimpleNamespace(request_id=r, ends=e, arrived=now) for r, e in rows]), times)) if rows else []
        for at in sorted(t for t in handle.timers if t <= now):
            out += lives.handleExpiredTimer((7,), times, SimpleNamespace(getExpiryTimeInMs=lambda: at))
            handle.timers.discard(at)
        return {r.request_id: (r.kind, r.first_arrived, r.last_arrived) for r in out}

    assert trigger(100, [(f"open{i}", False) for i in range(500)]) == {} and handle.timers == {5_100}
    assert trigger(200, [(f"ends{i}", i % 2 == 0) for i in range(400)]) == {} and handle.timers == {1_200, 5_100}
    assert trigger(900, [("ends0", False), ("ends1", False), ("ends1", True)]) == {}
    assert trigger(1_200) == {f"ends{i}": (K.ENDED, 200, 200) for i in range(2, 400, 2)}  # not ends0, which had a line since
    assert trigger(1_900) == {"ends0": (K.ENDED, 200, 900), "ends1": (K.ENDED, 200, 900)}
    assert trigger(2_000, [("ends0", False), ("open0", True)]) == {"ends0": (K.LATE, 2_000, 2_000)}
    assert trigger(3_000) == {"open0": (K.ENDED, 100, 2_000)}
    assert trigger(5_100, [("open1", False)]) == {"open1": (K.LIMIT, 100, 5_100)} | {f"open{i}": (K.LIMIT, 100, 100) for i in range(2, 500)}
    assert trigger(5_200) == {f"ends{i}": (K.LIMIT, 200, 200) for i in range(3, 400, 2)}
    assert "open" not in handle.held and not handle.timers and len(handle.held["over"]) == 900
    assert handle.calls < 100


def test_a_write_by_bucket_has_few_files_a_task(spark, tmp_path):
    from ledgerlens.streaming import completion as K
    own = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.enabled": "false"}
    was = {name: spark.conf.get(name) for name in own}
    x = _lines(["a"])[0]
    rows = [(f"r{r}", s * 4096, x, 0, None, None, None) for r in range(64) for s in range(30)] + [("hot", s * 4096, x, 0, None, None, None) for s in range(200)]
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        store = K.Store(spark, str(tmp_path / "out"), "chat")
        store.add(spark.createDataFrame(rows, "request_id string, seq long, line string, arrived long, kind string, first_arrived long, last_arrived long"), 0)
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    files = list((tmp_path / "out" / "lines").rglob("*.parquet"))
    assert 32 <= len(files) <= 4 * 32  # 32 tasks with a part of each of 32 buckets wrote several hundred
    kept = store._lines(spark, store.version["buckets"], list(store.version["buckets"])).select("request_id", "seq").collect()
    assert sorted((r[0], r[1]) for r in kept) == sorted((r[0], r[1]) for r in rows)
    from pyspark.sql import functions as F
    hot = spark.read.parquet(*map(str, files)).where("request_id = 'hot'").select(F.input_file_name()).distinct().count()
    assert hot >= 2  # the slices of a hot request are still in several files

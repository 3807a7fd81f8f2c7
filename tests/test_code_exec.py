"""Programs that misbehave end in time, with a fixed outcome."""
import time

import pytest

from ledgerlens.operators.code_exec import TOLD_MB, Interpreter, dealt, register_run_scripts, run_program


def timed(script, limit=1.0, **options):
    start = time.monotonic()
    out = run_program(script, limit, **options)
    return out, time.monotonic() - start


def test_programs_that_end():
    assert run_program("print('RESULTS: 1/1 tests passed')\nprint('other')", 10) == (0, "RESULTS: 1/1 tests passed\n", "", False)
    rc, out, err, late = run_program("import sys\nprint('x')\nprint('FAILED a', end='')\nsys.stderr.write('1\\n2\\n\\n3\\n4 é')\nsys.exit(3)", 10)
    assert (rc, out, err, late) == (3, "FAILED a", "2\n3\n4 é", False)
    assert run_program("", 10) == (0, "", "", False)
    rc, out, err, late = run_program("x = '" + "y" * 3_000_000 + "'\nprint('RESULTS', len(x))", 10)
    assert out == "RESULTS 3000000\n"


@pytest.mark.parametrize("script", [
    "while True: pass", "import time\ntime.sleep(60)",
    "import os, time\nif os.fork() == 0:\n    time.sleep(60)",  # the parent ends, its child holds the output
    "import os, time\nos.fork()\nos.fork()\ntime.sleep(60)",
    "import subprocess\nsubprocess.Popen(['sleep', '60'])",
    "import os, time\nif os.fork() == 0:\n    os.setsid()\n    time.sleep(6)",  # it leaves the group: the pipes aren't waited for
    "import sys\nwhile True: sys.stdout.write('x' * 100000)",
    "import signal, time\nsignal.signal(signal.SIGTERM, signal.SIG_IGN)\ntime.sleep(60)"])
def test_programs_that_would_not_end(script):
    out, seconds = timed(script)
    assert out == (None, "", "", True) and seconds < 4


def test_children_are_killed_with_their_program(tmp_path):
    alive = tmp_path / "alive"
    script = f"import os, time\nif os.fork() == 0:\n    time.sleep(2.5)\n    open({str(alive)!r}, 'w').close()"
    assert timed(script)[0][3]
    time.sleep(3)
    assert not alive.exists()


def test_memory_files_and_output_are_bounded(tmp_path):
    (rc, _, err, late), _ = timed("x = bytearray(2 << 30)", 10)
    assert rc == 1 and err.strip().endswith("MemoryError") and not late
    assert timed("x = bytearray(100 << 20)", 10)[0][0] == 0
    (rc, _, err, _), _ = timed(f"f = open({str(tmp_path / 'big')!r}, 'wb')\nfor _ in range(100): f.write(bytes(1 << 20))\nf.close()", 10)
    assert rc != 0 and (tmp_path / "big").stat().st_size <= 64 << 20
    (rc, out, err, late), _ = timed("while True: print('FAILED ' + 'x' * 10000)", 20)
    assert (rc, out, late) == (1, "", False) and err == f"OutputLimit: more than {TOLD_MB} MB of results"
    (rc, _, _, late), _ = timed("import resource\nresource.setrlimit(resource.RLIMIT_AS, (8 << 30, 8 << 30))", 10)
    assert rc == 0 or not late  # (a privileged user may raise its limits)


def test_table_function(spark):
    register_run_scripts(spark)
    df = spark.createDataFrame([(1, "print('RESULTS: 1/1')", "a"), (2, None, "b"), (3, "1/0", "a")], "id int, script string, tag string")
    got = spark.sql("SELECT * FROM run_scripts(TABLE({t}) PARTITION BY tag)", t=df)
    assert got.columns == ["id", "tag", "rc", "stdout", "stderr", "timed_out"]
    rows = {r.id: r for r in got.collect()}
    assert (rows[1].rc, rows[1].stdout, rows[2].rc, rows[3].rc) == (0, "RESULTS: 1/1\n", None, 1) and "ZeroDivisionError" in rows[3].stderr
    with pytest.raises(Exception, match="a column script"):
        spark.sql("SELECT * FROM run_scripts(TABLE({t}))", t=df.drop("script")).collect()


def test_programs_forked_from_one_interpreter():
    """Programs come from one interpreter that is started once, and leave nothing for the next; it is replaced when a program ends it."""
    import subprocess
    import sys
    one = Interpreter()
    try:
        run = lambda script, limit=5.0: run_program(script, limit, interpreter=one)
        assert run("import math, builtins\nmath.pi = 3\nbuiltins.left = 1\nx = 2\nprint('RESULTS', math.pi)")[1] == "RESULTS 3\n"
        first = one._process.pid
        assert run("import math\nprint('RESULTS', math.pi > 3, 'left' in dir(__builtins__), 'x' in globals())")[1] == "RESULTS True False False\n"
        assert run("while True: pass", 0.5) == (None, "", "", True)
        assert run("import os\nos.kill(os.getpid(), 9)")[0] == -9
        # as the interpreter started anew for a program does it
        for script in ("raise ValueError('x')", "x = = 1", "def f():\n    1/0\nf()", "import sys\nsys.exit('bye')", "import atexit\natexit.register(lambda: print('ERROR late'))",
                       "import os, sys\nprint('RESULTS', __name__, sorted(globals()), sys.argv, sys.path, sys.flags, dict(os.environ), sys.stdin.read(), sys.stdout.encoding, sys.getrecursionlimit())"):
            own = subprocess.run([sys.executable, "-I", "-"], input=script, capture_output=True, text=True, env={})
            told = "".join(x for x in own.stdout.splitlines(True) if x.startswith(("RESULTS", "FAILED", "ERROR")))
            assert run(script) == (own.returncode, told, "".join(own.stderr.splitlines(True)[-3:]), False)
        assert one._process.pid == first
        with pytest.raises(ChildProcessError):
            run("import os, time\nos.kill(os.getppid(), 9)\ntime.sleep(1)")
        assert run("print('RESULTS again')")[1] == "RESULTS again\n" and one._process.pid != first
    finally:
        one.close()


def test_programs_start_fast():
    """A program that does little costs a fork, not the start of an interpreter (before: 20 ms or more of CPU time each)."""
    import resource
    from ledgerlens.functions.extract import SCRIPT_IMPORTS
    used = lambda: sum(resource.getrusage(resource.RUSAGE_CHILDREN)[:2])
    script, n = "\n".join(SCRIPT_IMPORTS) + "\nprint('RESULTS: 1/1')", 60

    def many():
        one, before = Interpreter(), used()
        for _ in range(n):
            assert run_program(script, 10, interpreter=one)[1] == "RESULTS: 1/1\n"
        one._link.close()  # it ends by itself and its children's times count
        one._process.wait()
        one._process = None
        return used() - before

    def anew():
        before = used()
        for _ in range(n // 4):
            run_program(script, 10)
        return 4 * (used() - before)
    assert many() < anew() / 2


ENDS = {
    "method": "class A:\n    def __del__(self): print('RESULTS', 'gone')\na = A()",
    "method set late": "class A:\n    __slots__ = ()\nsetattr(A, '__de' + 'l__', lambda self: print('RESULTS gone'))\na = A()",
    "in a cycle": "class A: pass\nsetattr(A, '__de' + 'l__', lambda self: print('RESULTS gone'))\na = A()\na.a = a\ndel a",
    "in another module": "import collections\nclass A: pass\nsetattr(A, '__de' + 'l__', lambda self: print('RESULTS gone'))\ncollections.Counter.a = A()",
    "of a metaclass": "class M(type): pass\nsetattr(M, '__de' + 'l__', lambda self: print('RESULTS gone'))\nclass A(metaclass=M): pass",
    "in a frame": "class A: pass\nsetattr(A, '__de' + 'l__', lambda self: print('RESULTS gone'))\ndef f():\n    a = A()\n    raise SystemExit(3)\nf()",
    "generator": "def g():\n    try:\n        yield 1\n    finally:\n        print('RESULTS end')\nx = g()\nnext(x)",
    "coroutine": "async def g(): pass\nx = g()",
    "file": "f = open(1, 'w', closefd=False)\nf.write('RESULTS late')\nprint('RESULTS first')",
    "bytes": "import sys\nsys.stdout.buffer.write(b'RESULTS bytes')",
    "weak reference": "import weakref\nclass A: pass\na = A()\nr = weakref.ref(a, lambda x: print('RESULTS gone'))",
    "weak proxy": "import weakref\nclass A: pass\na = A()\nr = weakref.proxy(a, lambda x: print('RESULTS gone'))",
    "finalizer": "import weakref\nclass A: pass\na = A()\nr = weakref.finalize(a, print, 'RESULTS gone')",
    "at exit": "import atexit\natexit.register(print, 'RESULTS 1')\natexit.register(lambda: 1 / 0)\natexit.register(print, 'RESULTS 2')",
    "thread": "import threading, time\nthreading.Thread(target=lambda: (time.sleep(.2), print('RESULTS thread'))).start()",
    "low thread": "import _thread, time\n_thread.start_new_thread(lambda: (time.sleep(.2), print('RESULTS thread')), ())",
    "pool": "from concurrent.futures import ThreadPoolExecutor\nimport time\nThreadPoolExecutor(2).submit(lambda: (time.sleep(.2), print('RESULTS pool')))",
    "other output": "import io, sys\nsys.stdout = io.StringIO()\nprint('RESULTS lost')",
    "closed output": "import sys\nprint('RESULTS x')\nsys.stdout.close()",
    "closed pipe": "import os\nprint('RESULTS x')\nos.close(1)",
    "child": "import os\nprint('RESULTS before')\nif os.fork() == 0:\n    print('RESULTS child')\nelse:\n    os.wait()",
    "tracing": "import sys\nsys.settrace(lambda f, e, a: print('RESULTS', e, f.f_code.co_name))",
    "auditing": "import sys\nsys.addaudithook(lambda e, a: print('RESULTS', e))",
    "collector": "import gc\nprint('RESULTS', gc.get_freeze_count(), gc.isenabled())",
    "metaclass that answers": "class M(type):\n    def __eq__(s, o): print('RESULTS eq')\n    def __hash__(s): print('RESULTS hash'); return 1\n"
                              "    def __getattribute__(s, n): print('RESULTS get'); return type.__getattribute__(s, n)\nclass A(metaclass=M): pass\na = A()",
    "uncaught": "def f():\n    raise KeyError('é')\nf()", "group": "raise ExceptionGroup('g', [ValueError(1)])", "no module": "import nosuch",
    **{f"exit {x}": f"raise SystemExit({x})" for x in ("", "None", "True", "0", "255", "256", "-1", "2 ** 70", "'text'", "2.5")},
    "own exit": "class E(SystemExit):\n    code = 7\nraise E()", "quit": "quit()", "many": "a = [[] for _ in range(300000)]"}


def test_programs_end_as_in_an_interpreter_of_their_own():
    import subprocess
    import sys
    one = Interpreter()
    try:
        for name, script in ENDS.items():
            own = subprocess.run([sys.executable, "-I", "-"], input=script, capture_output=True, text=True, env={})
            told = "".join(x for x in own.stdout.splitlines(True) if x.startswith(("RESULTS", "FAILED", "ERROR")))
            said = "".join([x for x in own.stderr.splitlines(True) if x.strip()][-3:])
            assert run_program(script, 10, interpreter=one) == (own.returncode, told, said, False), name
    finally:
        one.close()


def _faults(script, n=20):
    """Memory pages that a program touches, with those of its fork."""
    import resource
    used = lambda: resource.getrusage(resource.RUSAGE_CHILDREN).ru_minflt

    def run(times):
        one, before = Interpreter(), used()
        for _ in range(times):
            assert run_program(script, 10, interpreter=one)[0] in (0, 1)
        one._link.close()
        one._process.wait()
        one._process = None
        return used() - before
    return (run(n + 1) - run(1)) / n


@pytest.mark.parametrize("script", ["print('RESULTS: 1/1')", "import re, random, json\nclass A:\n    x = [1]\na = A()\nraise SystemExit(1)", "1 / 0"])
def test_programs_end_fast(script):
    """The interpreter isn't taken down behind a program that can't tell (before: as many pages as with one that can)."""
    assert _faults(script) < _faults("class A:\n    def __del__(self): pass\na = A()\n" + script) * .6


def test_table_function_runs_programs_in_many_tasks(spark):
    """AQE made one task of u5's programs, as their scripts are small."""
    from ledgerlens.plans.registry import entries
    df = entries()["u5_table_function"].fn(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "run_scripts" in final and "coalesced" not in final and final.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n", [1, 7, 51])
def test_programs_are_dealt_evenly(spark, n):
    """One value of the bucket in each partition, and each with its share of the rows (before: from none to several of 8 n buckets)."""
    from pyspark.sql import functions as F
    rows = dealt(spark.range(400 * n), ["id"], n).groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("bucket").alias("buckets"), F.count("*").alias("rows")).collect()
    assert len(rows) == n and all(r.buckets == 1 and 300 < r.rows < 500 for r in rows)

"""Run extracted programs against their tests.

Executing untrusted code is the one place that genuinely needs a Python worker:
``mapInPandas`` hands Arrow batches of ``(key, script)`` to each task, every script
runs in an isolated interpreter of its own (``python -I``, script on stdin, a process group
and resource limits of its own, hard time limit), and only the raw ``(rc, stdout, stderr, timed_out)`` comes back.
An interpreter starts slower than most programs run, so a task starts one (:class:`Interpreter`) that never runs a program, and forks
each program's from it.
Parsing that output into pass counts and error text stays in column expressions
(:func:`ledgerlens.functions.extract.run_outcome`).

Rows are spread round-robin over ``partitions`` tasks first, so the work of a
large or skewed input does not stay in the few tasks of the source scan.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.extract import code_grade, run_outcome, test_script

RUN_FIELDS = [
    T.StructField("rc", T.IntegerType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("timed_out", T.BooleanType()),
]


#: Lines of a program's output that the grade reads; all others are dropped as they come.
TOLD = (b"RESULTS", b"FAILED", b"ERROR")
PIECE = 1 << 16
#: What a program may use: address space, a file, and output that the grade reads.
MEMORY_MB, FILE_MB, TOLD_MB = 1024, 64, 16


class _Told:
    """The lines that begin with a word of :data:`TOLD`; a line without end takes no memory unless it is kept."""

    def __init__(self):
        self.kept, self._head, self._keep = bytearray(), bytearray(), None

    def feed(self, data: bytes) -> None:
        for k, part in enumerate(data.split(b"\n")):
            if k:
                self._end(b"\n")
            if self._keep is None:
                self._head += part[:PIECE]
                if len(self._head) >= 8:
                    self._keep = self._head.startswith(TOLD)
                    if self._keep:
                        self.kept += self._head + part[PIECE:]
                    self._head.clear()
            elif self._keep:
                self.kept += part

    def _end(self, mark: bytes) -> None:
        if self._keep or (self._keep is None and self._head.startswith(TOLD)):
            self.kept += self._head + mark
        self._head.clear()
        self._keep = None

    def text(self) -> str:
        self._end(b"")
        return self.kept.decode("utf-8", "replace")


class _Last:
    """The last three lines, blank ones aside, each cut at :data:`PIECE` bytes."""

    def __init__(self):
        from collections import deque
        self._lines, self._line = deque(maxlen=3), bytearray()

    def feed(self, data: bytes) -> None:
        for k, part in enumerate(data.split(b"\n")):
            if k:
                self._end(b"\n")
            self._line += part[:PIECE - len(self._line)]

    def _end(self, mark: bytes) -> None:
        if self._line.strip():
            self._lines.append(bytes(self._line) + mark)
        self._line.clear()

    def text(self) -> str:
        self._end(b"")
        return b"".join(self._lines).decode("utf-8", "replace")


def _bound(pid: int, timeout_s: float, memory_mb: int) -> None:
    """Limits for a program that hasn't got its script yet, and for all that it starts; it can't raise them."""
    import math
    import resource
    for kind, most in ((resource.RLIMIT_AS, memory_mb << 20), (resource.RLIMIT_FSIZE, FILE_MB << 20), (resource.RLIMIT_CORE, 0), (resource.RLIMIT_CPU, math.ceil(timeout_s) + 1)):
        resource.prlimit(pid, kind, (most, most))


#: What a clean interpreter does: for each script's three pipes it forks, tells the process id, then how the process ended, and takes it off the
#: process table when the group has been killed.  The forked one reads its script to the end and runs it as ``python -I -`` does; the
#: modules that every script imports, and those that many do, are there already.
#:
#: Taking an interpreter down took 17 of a short program's 20 ms.  So a program whose end can't tell the difference (``unseen``) is ended by
#: flushing its output and leaving; any other is taken down in full.  What can tell is what runs or is written then: threads, functions for
#: the end, modules of its own, ``__del__`` and all that closes itself (files, generators: their types have ``__del__`` too), and functions
#: called when a weak reference's object goes.  ``freeze`` keeps what was there before apart, so ``get_objects`` has all that the program left.
FORKS = """
import _thread, _weakref, atexit, bisect, builtins, collections, copy, datetime, functools, gc, heapq, itertools, json, math, operator, os
import random, re, string, sys, time, traceback, types, typing, _socket

def serve(link):
    while True:
        data, sent, _, _ = link.recvmsg(1, _socket.CMSG_SPACE(12))
        if not data:
            os._exit(0)
        pipes = [int.from_bytes(sent[0][2][i:i + 4], sys.byteorder) for i in (0, 4, 8)]
        pid = os.fork()
        if pid == 0:
            link.close()
            os.setsid()
            for i, pipe in enumerate(pipes):
                os.dup2(pipe, i)
                os.close(pipe)
            return
        for pipe in pipes:
            os.close(pipe)
        link.sendall(pid.to_bytes(8, "little"))
        end = os.waitid(os.P_PID, pid, os.WEXITED | os.WNOWAIT)
        link.sendall((end.si_status if end.si_code == os.CLD_EXITED else -end.si_status).to_bytes(8, "little", signed=True))
        if not link.recv(1):
            os._exit(0)
        os.waitpid(pid, 0)

# a program that names one of these may see more of the interpreter than is looked at below
special = re.compile(rb"__del__|\\bgc\\b|settrace|setprofile|monitoring|warnings|scandir|audithook|_shutdown").search
line, own_names, told = type.__dict__["__mro__"].__get__, type.__dict__["__dict__"].__get__, _weakref.ref.__dict__["__callback__"].__get__
proxies = {_weakref.ProxyType, _weakref.CallableProxyType}
of_abc = lambda f: type(f) is types.BuiltinFunctionType and f.__name__ == "_destroy"  # isinstance() of an abstract class keeps what it was asked, and forgets it so

def unseen():
    if _thread._count() or getattr(sys.modules.get("threading"), "_threading_atexits", None) or atexit._ncallbacks() != callbacks:
        return False
    atexit._run_exitfuncs()  # (the interpreter's own, which are not run twice)
    if _thread._count() or sys.modules.keys() != modules or sys.stdout is not streams[0] or sys.stderr is not streams[1]:
        return False  # (a module may end in ways of its own)
    made = gc.get_objects()
    if len(made) > 200_000:
        return False  # looking at them all takes a time that counts for the program
    kinds = {id(type(x)): type(x) for x in made}
    lines = {k: line(kind) for k, kind in kinds.items()}
    of = lambda kind: {k for k, above in lines.items() if any(c is kind for c in above)}
    classes, refs = of(type), of(_weakref.ref)
    above = {id(c): c for x in made if id(type(x)) in classes for c in line(x)} | {id(c): c for k in lines for c in lines[k]}
    return not (any("__del__" in own_names(c) for c in above.values()) or any(id(kind) in kinds for kind in proxies)
                or any(told(x) is not None and not of_abc(told(x)) for x in made if id(type(x)) in refs))

def leave(status):
    try:
        if unseen():
            sys.stdout.flush()
            sys.stderr.flush()
            os._exit(status)
    except Exception:
        pass
    gc.unfreeze()

modules, callbacks = set(sys.modules), atexit._ncallbacks()
gc.collect()
gc.freeze()
serve(_socket.socket(_socket.AF_UNIX, _socket.SOCK_STREAM, 0, int(sys.argv[1])))
sys.argv = ["-"]
own, main = sys.modules["__main__"], types.ModuleType("__main__")
main.__dict__.update(__annotations__={}, __builtins__=builtins, __cached__=None, __file__="<stdin>", __loader__=own.__loader__)
sys.modules["__main__"] = main
streams, script = (sys.stdout, sys.stderr), sys.stdin.buffer.read()
in_full = special(script)
if in_full:
    gc.unfreeze()
try:
    exec(compile(script, "<stdin>", "exec", dont_inherit=True), main.__dict__)
    if not in_full:
        leave(0)
except SystemExit as end:
    if not in_full and type(end) is SystemExit and (end.code is None or type(end.code) is int and 0 <= end.code < 256):
        leave(end.code or 0)
    gc.unfreeze()
    raise
except BaseException as problem:
    problem = problem.with_traceback(problem.__traceback__.tb_next)
    sys.excepthook(type(problem), problem, problem.__traceback__)
    if not in_full:
        leave(1)
    sys.exit(1)
"""


class Interpreter:
    """A clean interpreter with an empty environment, from which programs' processes are forked, one at a time."""

    def __init__(self):
        self._process = self._link = None

    def _start(self) -> None:
        import socket
        import subprocess
        import sys
        self._link, other = socket.socketpair()
        try:
            self._process = subprocess.Popen([sys.executable, "-I", "-c", FORKS, str(other.fileno())], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL,
                                             stderr=subprocess.DEVNULL, env={}, start_new_session=True, pass_fds=(other.fileno(),))
        finally:
            other.close()

    def _told(self) -> int:
        data = b""
        while len(data) < 8:
            part = self._link.recv(8 - len(data))
            if not part:
                raise ChildProcessError("the interpreter that programs are forked from has ended")
            data += part
        return int.from_bytes(data, "little", signed=True)

    def fork(self, pipes: list[int]) -> int:
        """The id of a new process that reads its script from the first pipe and writes to the others."""
        import socket
        if self._process is None or self._process.poll() is not None:
            self.close()
            self._start()
        socket.send_fds(self._link, [b"f"], pipes)
        return self._told()

    def ended(self, seconds: float | None = None) -> int | None:
        """The process's return code (negative: the signal), or None while it runs."""
        import select
        return self._told() if seconds is None or select.select([self._link], [], [], max(0.0, seconds))[0] else None

    def forget(self) -> None:
        self._link.sendall(b"w")

    def close(self) -> None:
        if self._process is not None:
            self._link.close()
            self._process.kill()
            self._process.wait()
            self._process = None


def run_program(script: str, timeout_s: float, memory_mb: int = MEMORY_MB, interpreter: Interpreter | None = None) -> tuple:
    """(rc, stdout lines that count, last stderr lines, timed out) of a program in an interpreter of its own
    with an empty environment, a process group of its own and bounded resources.

    It is over when it and all that hold its output have ended, or at its limit; then the whole group is killed, and no pipe is waited for."""
    if interpreter is None:
        interpreter = Interpreter()
        try:
            return run_program(script, timeout_s, memory_mb, interpreter)
        finally:
            interpreter.close()
    import os
    import selectors
    import signal
    import time

    told, last, left = _Told(), _Last(), memoryview(script.encode("utf-8", "surrogatepass"))
    (its_in, to), (out, its_out), (err, its_err) = os.pipe(), os.pipe(), os.pipe()
    own, open_pipes, too_much, pid, rc = {to, out, err}, {out: told, err: last}, False, None, None
    try:
        try:
            pid = interpreter.fork([its_in, its_out, its_err])
        finally:
            for pipe in (its_in, its_out, its_err):
                os.close(pipe)
        deadline = time.monotonic() + timeout_s
        _bound(pid, timeout_s, memory_mb)
        with selectors.DefaultSelector() as ready:
            for pipe, kind in ((to, selectors.EVENT_WRITE), (out, selectors.EVENT_READ), (err, selectors.EVENT_READ)):
                os.set_blocking(pipe, False)
                ready.register(pipe, kind)
            while open_pipes and not too_much and (wait := deadline - time.monotonic()) > 0:
                for key, _ in ready.select(wait):
                    pipe = key.fd
                    if pipe == to:
                        try:
                            left = left[os.write(pipe, left[:PIECE]):] if left else left
                        except BrokenPipeError:
                            left = left[:0]  # it ended before it had read all
                        if not left:
                            ready.unregister(pipe)
                            own.remove(pipe)
                            os.close(pipe)
                    elif data := os.read(pipe, PIECE):
                        open_pipes[pipe].feed(data)
                        too_much = len(told.kept) > TOLD_MB << 20
                    else:
                        ready.unregister(pipe)
                        del open_pipes[pipe]
        if not open_pipes:
            rc = interpreter.ended(deadline - time.monotonic())
    finally:
        for pipe in own:
            os.close(pipe)
        if pid is not None:
            for kill in (os.killpg, os.kill):  # it stays on the process table till it is forgotten, so the id is its own
                try:
                    kill(pid, signal.SIGKILL)
                except ProcessLookupError:
                    pass
            if rc is None:
                interpreter.ended()
            interpreter.forget()
    if too_much:
        return (1, "", f"OutputLimit: more than {TOLD_MB} MB of results", False)
    return (rc, told.text(), last.text(), False) if rc is not None else (None, "", "", True)


def _ran(script: str | None, timeout_s: float, interpreter: Interpreter) -> tuple:
    if script is None:
        return (None, None, None, False)
    try:
        return run_program(script, timeout_s, interpreter=interpreter)
    except Exception as e:  # noqa: BLE001 - reported as the run's stderr
        interpreter.close()  # the next program gets another
        return (1, "", f"{type(e).__name__}: {e}", False)


def _runner(script_col: str, timeout_s: float, per_task: int):
    def run(batches):
        from concurrent.futures import ThreadPoolExecutor
        from queue import SimpleQueue
        interpreters, free = [Interpreter() for _ in range(per_task)], SimpleQueue()
        for x in interpreters:
            free.put(x)

        def one(script):
            interpreter = free.get()
            try:
                return _ran(script, timeout_s, interpreter)
            finally:
                free.put(interpreter)

        try:
            with ThreadPoolExecutor(max_workers=per_task) as pool:
                for pdf in batches:
                    res = list(pool.map(one, pdf[script_col].tolist()))
                    out = pdf.drop(columns=[script_col])
                    for k, name in enumerate(("rc", "stdout", "stderr", "timed_out")):
                        out[name] = [r[k] for r in res]
                    out["rc"] = out["rc"].astype("Int32")
                    yield out
        finally:
            for x in interpreters:
                x.close()
    return run


def run_scripts(df: DataFrame, keys: Sequence[str], script_col: str = "script", timeout_s: float = 5,
                partitions: int | None = None, per_task: int = 2) -> DataFrame:
    """``(keys..., script)`` → ``(keys..., rc, stdout, stderr, timed_out)``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(*keys, script_col).repartition(n)
    schema = T.StructType([f for f in narrow.schema.fields if f.name != script_col] + RUN_FIELDS)
    return narrow.mapInPandas(_runner(script_col, timeout_s, per_task), schema)


def _partition_of(value: int, n: int) -> int:
    """The one of n partitions to which Spark deals a long: its Murmur3 hash, modulo n."""
    full = (1 << 32) - 1
    turned = lambda x, by: (x << by | x >> 32 - by) & full
    h = 42
    for word in (value & full, value >> 32 & full):
        h = (turned(h ^ turned(word * 0xCC9E2D51 & full, 15) * 0x1B873593 & full, 13) * 5 + 0xE6546B64) & full
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % n


def dealt(df: DataFrame, keys: Sequence[str], n: int, bucket: str = "bucket") -> DataFrame:
    """``df`` dealt evenly over n partitions by a hash of ``keys``, with a column for ``PARTITION BY`` that has one value in each.

    Values from 0 to n - 1 would leave some partitions empty and others with several; if Spark dealt longs otherwise, these would as well."""
    values, k = {}, 0
    while len(values) < n:
        values.setdefault(_partition_of(k, n), k)
        k += 1
    listed = F.split(F.lit(",".join(str(values[p]) for p in range(n))), ",").cast("array<bigint>")
    at = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int") + 1
    return df.withColumn(bucket, F.element_at(listed, at)).repartition(n, bucket)


def register_run_scripts(spark: SparkSession, name: str = "run_scripts", timeout_s: float = 5) -> None:
    """U5 as a table function for SQL: ``SELECT * FROM run_scripts(TABLE(programs) PARTITION BY bucket)``.

    The table's columns come back, but for ``script``, with rc, stdout, stderr and timed_out behind them; a null script isn't run."""
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

    class RunScripts:
        @staticmethod
        def analyze(programs: AnalyzeArgument) -> AnalyzeResult:
            if not programs.isTable or "script" not in programs.dataType.fieldNames():
                raise ValueError("run_scripts takes a table with a column script")
            return AnalyzeResult(T.StructType([f for f in programs.dataType.fields if f.name != "script"] + RUN_FIELDS))

        def __init__(self):
            self._interpreter = Interpreter()

        def eval(self, row):
            yield (*[row[c] for c in row.__fields__ if c != "script"], *_ran(row["script"], timeout_s, self._interpreter))

        def terminate(self):
            self._interpreter.close()

    spark.udtf.register(name, udtf(RunScripts))


def grade_code(df: DataFrame, keys: Sequence[str], code_col: str = "code", tests_col: str = "tests",
               timeout_s: float = 5, partitions: int | None = None) -> DataFrame:
    """X9 + X10: run rows that have code and tests, then grade every row.

    One pass: every row carries its own columns through the worker, and only rows with
    code and tests get a script, so only they start a child interpreter; the fixed
    outcome of the others is a column expression.  Nothing is matched back by key,
    and the extraction that produced ``code_col`` is evaluated once.
    """
    keys = list(keys)
    runnable = F.coalesce(F.length(code_col) > 0, F.lit(False)) & F.coalesce(F.size(tests_col) > 0, F.lit(False))
    carried = keys + [c for c in (code_col, tests_col) if c not in keys]
    prepared = df.select(*carried, F.when(runnable, test_script(code_col, tests_col)).alias("script"))
    ran = run_scripts(prepared, carried, "script", timeout_s, partitions)
    outcome = run_outcome(tests_col, "rc", "stdout", "stderr", F.coalesce(F.col("timed_out"), F.lit(False)),
                          _fmt_timeout(timeout_s))
    graded = ran.withColumn("g", code_grade(code_col, tests_col, outcome))
    return graded.select(*keys, "g.all_passed", "g.tests_passed", "g.tests_total", "g.execution_error")


def _fmt_timeout(t: float) -> str:
    return str(int(t)) if float(t).is_integer() else str(t)

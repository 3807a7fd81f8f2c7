"""Quality by weak supervision: rules vote good (1), bad (-1) or abstain (0); nobody says which rule is right.

Expectation-maximisation takes each document's true quality as hidden and estimates, for good and for bad documents,
how often each rule casts each vote, and how many documents are good.  Two rules look at each usual fault, so that they
confirm each other.  A document's verdict is the
posterior probability that it is good, not that it passes every rule.  All of it are DataFrame functions: the rules read
counts that one pass over the text writes to the shared folder; the estimation reads the table of vote
patterns, which has at most 3 ** (number of rules) rows, and brings one row of sums to the driver per step.
A Dirichlet prior worth ``PRIOR`` of all rows stands for what the rules were written to say and keeps the
two hidden classes from trading places.

Null and empty texts have all counts 0, and so fail the base test (too few words).  Repeated rows vote each.  A null doc_id is
scored like others.  Extra columns are ignored.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stage

PRIOR, STEPS, MOVED, VERDICT = 1.0, 25, 1e-5, 0.5
#: Where the estimation starts and what the prior holds: bad and good votes from bad documents, from good documents.
START = {"bad": (0.30, 0.60), "good": (0.003, 0.85)}
START_GOOD = 0.85


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules read, one row per document; no row needs another one, so nothing is shuffled."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("w", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}")))
    df = df.withColumn("h", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<long>")))
    return df.select(
        "doc_id", "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_covered(F.col("h"))).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_kinds"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"))


def _covered(h: Column) -> Column:
    """Words in 3-word windows whose hash occurs more than once: equal ones are neighbours once sorted."""
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    both = F.arrays_zip(ranked.alias("e"), F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), ranked).alias("l"), F.slice(ranked, F.lit(2), F.greatest(F.size(ranked), F.lit(1))).alias("r"))
    again = F.filter(both, lambda t: t["e"].isNotNull() & (t["e"]["x"].eqNullSafe(t["l"]["x"]) | t["e"]["x"].eqNullSafe(t["r"]["x"])))
    places = F.array_sort(F.transform(again, lambda t: t["e"]["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def _vote(bad: Column, good: Column) -> Column:
    return F.coalesce(F.when(bad, -1).when(good, 1), F.lit(0))


def votes() -> dict[str, Column]:
    """The rules, by name.  They abstain where they can't tell."""
    c, some = F.col, F.col("n_words") > 0
    share = lambda x, y: F.try_divide(c(x), c(y))
    return {
        "length": _vote(c("n_words") < 20, c("n_words").between(50, 100_000)),
        "word_length": _vote(some & ~share("word_chars", "n_words").between(2.0, 14.0), share("word_chars", "n_words").between(3.0, 11.0)),
        "symbols": _vote(share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.03),
        "symbol_runs": _vote(share("n_symbol_runs", "n_words") > 0.1, share("n_symbol_runs", "n_words") < 0.03),
        "repeated_lines": _vote(share("n_dup_lines", "n_lines") > 0.6, share("n_dup_lines", "n_lines") <= 0.1),
        "repeated_words": _vote(share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.15),
        "variety": _vote((c("n_words") <= 1000) & (share("n_kinds", "n_words") < 0.3), (c("n_words") <= 1000) & (share("n_kinds", "n_words") > 0.45)),
        "capitals": _vote(share("n_capitals", "word_chars") > 0.3, share("n_capitals", "word_chars") < 0.1),
        "marks": _vote(share("n_marks", "n_words") > 0.3, share("n_marks", "n_words") < 0.1),
    }


def posterior(good: float, rates: dict[str, dict[str, tuple[float, float]]]) -> Column:
    """Probability that a document with the votes in columns ``vote_<rule>`` is good.  rates: of each rule, for both classes,
    the share of bad and of good votes."""
    odds = F.log(F.lit(good)) - F.log(F.lit(1.0 - good))
    for rule, by in rates.items():
        v = F.col(f"vote_{rule}")
        for vote, pick in ((-1, lambda r: r[0]), (1, lambda r: r[1]), (0, lambda r: 1.0 - r[0] - r[1])):
            odds = odds + F.when(v == vote, F.log(F.lit(pick(by["good"]))) - F.log(F.lit(pick(by["bad"])))).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: list[str], steps: int = STEPS, prior: float = PRIOR) -> tuple[float, dict]:
    """Share of good documents and each rule's rates, from rows (vote_<rule> ..., n)."""
    good, rates = START_GOOD, {rule: dict(START) for rule in rules}
    for _ in range(steps):
        p, n = F.col("p"), F.col("n")
        sums = [F.sum(n).alias("n"), F.sum(n * p).alias("good")]
        for rule in rules:
            for name, weight in (("bad", n * (1 - p)), ("good", n * p)):
                sums += [F.sum(F.when(F.col(f"vote_{rule}") == vote, weight).otherwise(0.0)).alias(f"{rule}_{name}_{vote + 1}") for vote in (-1, 1)]
        got = patterns.withColumn("p", posterior(good, rates)).agg(*sums).first()
        if not got["n"]:
            break
        held = prior * got["n"]
        new_good = (got["good"] + held * START_GOOD) / (got["n"] + held)
        new = {}
        for rule in rules:
            new[rule] = {}
            for name, total, own in (("bad", got["n"] - got["good"], held * (1 - START_GOOD)), ("good", got["good"], held * START_GOOD)):
                new[rule][name] = tuple((got[f"{rule}_{name}_{k}"] + own * START[name][k // 2]) / (total + own) for k in (0, 2))
        step = max([abs(new_good - good), *(abs(a - b) for r in rules for c in START for a, b in zip(new[r][c], rates[r][c]))])
        good, rates = new_good, new
        if step < MOVED:
            break
    return good, rates


def mark(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the counts, base_failed, kept, posterior and the votes of every row."""
    rules = votes()
    voted = stage(counts(docs).withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    patterns = stage(voted.groupBy(*[f"vote_{k}" for k in rules]).agg(F.count(F.lit(1)).alias("n")), "patterns")
    good, rates = estimate(patterns, list(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (voted.withColumn("posterior", posterior(good, rates)).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("posterior") >= VERDICT)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that ``mark`` keeps; rows that share a doc_id stay if any of them does."""
    kept = mark(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]), "left_semi")

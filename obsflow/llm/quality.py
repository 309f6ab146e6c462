"""Quality rules with cutoffs that limit false rejection, in DataFrame functions only.

A rule rejects a document when a share of it exceeds a cutoff.  For each stratum, rule and
cutoff the labelled holdout tells how many of its n good documents would be rejected, k.
The cutoff is certified when the exact binomial probability of k or fewer rejections, at a
true rate of ``limit`` / number of rules, is at most ``error`` / number of tests
(Bonferroni over all strata, rules and cutoffs).  With probability 1 - ``error`` all
certified cutoffs together reject at most ``limit`` of the good documents of each stratum.
Of a rule's certified cutoffs that reject bad documents at least ``lift`` times as often as
good ones, the one that separates them best is used, the loosest of equal ones; a rule
without one does not apply in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.plans import runtime

# ASCII white space and the symbols that are counted.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Per rule: numerator, denominator, cutoffs in thousandths of the ratio.
RULES = {
    "symbols": ("n_symbols", "word_chars", [10, 20, 30, 50, 80, 120, 200, 300]),
    "dup_lines": ("n_dup_lines", "n_lines", [50, 100, 150, 200, 300, 400, 500, 700]),
    "repeat_words": ("n_repeat_words", "n_words", [50, 100, 150, 200, 250, 300, 400]),
    "word_length": ("word_chars", "n_words", [5000, 6000, 7000, 8000, 9000, 10000, 12000]),
}
LIMIT = 0.1
ERROR = 0.05
LIFT = 20
# Terms of a binomial tail that are added; the rest is bounded by a geometric series.
TERMS = 1000
_POSITION = (1 << 30) - 1


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every row; null texts have none.

    Repeated windows are found in each document's own arrays: windows are hashed, sorted
    with their positions, neighbours with equal hash bits are compared as words, and the
    positions that are left give the covered words.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id", "stratum",
        F.length(_without(F.col("text"), SPACE)).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: _without(x, SPACE) != "").alias("lines"),
        F.filter(F.split(F.translate("text", SPACE, " " * len(SPACE)), " "), lambda x: x != "").alias("w"))
    d = d.select(
        "doc_id", "stratum", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.size("w").cast("bigint").alias("n_words"), "w",
        F.sort_array(F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(~_POSITION).bitwiseOR(i.cast("bigint"))),
                             1, F.greatest(F.size("w") - 2, F.lit(0)))).alias("h"))

    def bits(c: Column) -> Column:
        return F.shiftright(c, 30)

    d = d.withColumn("c", F.filter("h", lambda x, i: (bits(x) == bits(F.get("h", i + 1))) | (bits(x) == bits(F.get("h", i - 1)))))

    def window(x: Column) -> Column:
        p = x.bitwiseAND(F.lit(_POSITION)).cast("int")
        return F.struct(F.concat_ws(" ", F.get("w", p), F.get("w", p + 1), F.get("w", p + 2)).alias("k"), p.alias("p"))

    d = d.withColumn("s", F.sort_array(F.transform("c", window))).drop("h", "c", "w")
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: (x["k"] == F.get("s", i + 1)["k"]) | (x["k"] == F.get("s", i - 1)["k"])), lambda x: x["p"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_factorial(x: Column) -> Column:
    """Stirling's series, below 16 from a table; off by less than 1e-10."""
    x = x.cast("double")
    small, x = x, F.greatest(x, F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(small < 16, F.get(F.lit([math.lgamma(i + 1) for i in range(16)]), small.cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate) where k is below the mean, else 1; never too small.

    Terms fall at least geometrically from k down, so after ``TERMS`` of them the rest is
    at most the last one times ratio / (1 - ratio).
    """
    odds = (1 - rate) / rate
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log(1 - rate)

    def add(acc: Column, i: Column) -> Column:
        r = (k - i) * odds / (n - k + i + 1)
        return F.struct((acc["t"] * r).alias("t"), (acc["s"] + acc["t"] * r).alias("s"), r.alias("r"))

    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), F.lit(0.0).alias("r"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.least(k, F.lit(TERMS)), F.lit(1)) - 1), start, add,
                        lambda acc: acc["s"] + F.when(k > TERMS, acc["t"] * acc["r"] / (1 - acc["r"])).otherwise(0.0))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * F.when(k == 0, F.lit(1.0)).otherwise(total)))


def cutoffs(held: DataFrame, rules=RULES, limit: float = LIMIT, error: float = ERROR, lift: int = LIFT) -> DataFrame:
    """One row a stratum with the cutoff of each rule (null: none is certified), from ``held``: features and ``good`` boolean."""
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).cast("bigint").alias("cutoff"), (1000 * F.col(a) > c * F.col(b)).alias("rejects")) for r, (a, b, cs) in rules.items() for c in cs])
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    t = (held.select("stratum", "good", F.explode(tests).alias("t")).groupBy("stratum", F.col("t.rule").alias("rule"), F.col("t.cutoff").alias("cutoff"))
         .agg(count(F.col("good")).alias("n"), count(F.col("good") & F.col("t.rejects")).alias("k"), count(~F.col("good")).alias("nb"), count(~F.col("good") & F.col("t.rejects")).alias("kb")))
    t = runtime.checkpoint(t)
    tests_made = max(t.count(), 1)
    gain = F.col("kb") * F.col("n") - F.col("k") * F.col("nb")
    sure = t.filter(binomial_tail(F.col("n"), F.col("k"), limit / len(rules)) <= error / tests_made).filter((gain > 0) & (F.col("kb") * F.col("n") >= lift * F.col("k") * F.col("nb")))
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct(gain.cast("decimal(38,0)").alias("g"), "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules])


def rule_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality",
                  rules=RULES, limit: float = LIMIT, error: float = ERROR, lift: int = LIFT) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of every row of ``docs``.

    ``labels`` has the id and 1 for good, 0 for bad documents (null: not labelled); every
    row of a labelled id counts.  Only rows that pass the base rules take part.  A null
    stratum is a stratum; without labelled rows only the base rules apply.
    """
    f = runtime.checkpoint(features(docs, id_col, text_col, stratum_col).withColumn("base_failed", base_failed()))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col(good_col) == 1).alias("good")).filter("good is not null")
    cuts = runtime.small(runtime.checkpoint(cutoffs(f.filter("not base_failed").join(known, "doc_id"), rules, limit, error, lift)))
    out = f.join(cuts.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    fails = [F.coalesce(1000 * F.col(a) > F.col(f"cut_{r}") * F.col(b), F.lit(False)) for r, (a, b, _) in rules.items()]
    rejected = fails[0]
    for x in fails[1:]:
        rejected = rejected | x
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))

"""Quality rules whose cutoffs carry a guarantee on false rejection. DataFrame functions only.

Per document: word, symbol, line and repetition counts. A rule rejects when its statistic exceeds a cutoff.
Cutoffs come from labelled good documents: in each stratum, each (rule, cutoff) of a fixed grid is a test of
"the rule rejects more than alpha / n_rules of the good documents"; the exact binomial tail gives its p-value,
Bonferroni over all strata, rules and cutoffs keeps the family-wise error under delta. The strictest certified cutoff
of a rule is used; a rule with none never rejects in that stratum. So with confidence 1 - delta, in every stratum at
most alpha of good documents are rejected by the rules together.

Defined results: null or empty text has no words, fails the base rules and is not kept; null lang is a stratum of its
own; repeated rows are judged alike; an empty table or empty labels give no certified cutoff; a document with several
labels counts as good only if all say so; null doc_ids have no label; very long texts are counted whole; of equally strict cutoffs
there is one, the grid's first that is certified, and a statistic equal to it passes; columns of docs that are called like
an added one are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import SPACE_CHARS, SPACE_CLASS, WORD_PATTERN, let, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Statistic (an integer, per 1000 words but for word length, in 1/1000 characters) and its grid of cutoffs.
RULES = {
    "symbol_rate": (50, 100, 200, 400, 800, 1600),
    "dup_line_rate": (10, 20, 40, 80, 160),
    "word_length": (7000, 9000, 12000, 16000, 24000),
    "repeat_rate": (25, 50, 100, 150),
}
ALPHA = 0.02
DELTA = 0.05


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more; sorts only texts that have such a window."""
    last = n - WINDOW

    def spread(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
        twice = let(pairs, lambda p: F.transform(F.filter(p, lambda x, i: same(p, x, i - 1) | same(p, x, i + 1)), lambda x: x["i"]))
        gaps = let(F.sort_array(twice), lambda at: F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spread(h)))
    return F.when(last < 1, F.lit(0)).otherwise(some)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    counts = let(F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w, F.size(w)).alias("r")))
    out = docs.withColumn("_counts", counts)
    out = out.withColumns({
        "n_words": F.col("_counts.n").cast("long"),
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_counts.r").cast("long"),
    })
    return out.drop("_counts").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _statistics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    per_mille = lambda c: F.floor(F.col(c) * 1000 / words).cast("long")
    return {"symbol_rate": per_mille("n_symbols"), "dup_line_rate": per_mille("n_dup_lines"), "word_length": per_mille("word_chars"), "repeat_rate": per_mille("n_repeat_words")}


def binomial_tail(n: Column, x: Column, p: float) -> Column:
    """P(Bin(n, p) <= x), summed from x downwards in logs so that large n do not underflow.

    log C(n, k) comes from Stirling's series with exact values below 16, to about 1e-10.
    """
    def log_factorial(k):
        k = k.cast("double")
        exact = F.log(F.factorial(F.least(k, F.lit(15.0)).cast("int")))
        m = F.greatest(k, F.lit(16.0))
        series = m * F.log(m) - m + 0.5 * F.log(2 * F.lit(3.141592653589793) * m) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
        return F.when(k < 16, exact).otherwise(series)

    log_p, log_q = F.log(F.lit(p)), F.log(F.lit(1 - p))
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * log_p + (n - x) * log_q
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, i):
        k = x - i
        term = acc["term"] * (k + 1) / (n - k) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    below = F.when(x > 0, F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(below, one, step, lambda acc: acc["total"])
    # beyond the mean the null hypothesis can't be rejected; the sum is only needed (and short) below it
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def calibrate(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: a cutoff column per rule (null: none certified). stats: rows of with_stats."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1")
    values = _statistics()
    rows = stats.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id", "left_semi").select(F.col(stratum).alias("stratum"), *[c.alias(k) for k, c in values.items()])
    tests = [(k, c) for k, grid in RULES.items() for c in grid]
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum((F.col(k) > c).cast("long")).alias(f"x_{k}_{c}") for k, c in tests])
    counts = materialize(counts, "quality-counts")
    share = alpha / len(RULES)
    level = F.lit(delta / (max(1, counts.count()) * len(tests)))
    cutoff = {k: F.coalesce(*[F.when(binomial_tail(F.col("n"), F.col(f"x_{k}_{c}"), share) <= level, F.lit(c).cast("long")) for c in grid]) for k, grid in RULES.items()}
    return counts.select("stratum", *[c.alias(f"cut_{k}") for k, c in cutoff.items()])


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add kept: neither base_failed nor above a certified cutoff. cutoffs has a row per stratum and is tiny."""
    named = cutoffs.select(F.col("stratum").alias("_stratum"), *[F.col(f"cut_{k}").alias(f"_cut_{k}") for k in RULES])
    joined = stats.join(named, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    broken = F.lit(False)
    for k, c in _statistics().items():
        broken = broken | F.coalesce(c > F.col(f"_cut_{k}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~broken).drop(*named.columns)

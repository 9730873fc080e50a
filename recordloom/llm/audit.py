"""Which filter removes what, and how much of it is its own doing.

Five filters on documents; per part, documents are counted by the mask of filters that they fail. The counts n(m) make the
part's removal polynomial, the multilinear extension f(x) = sum n(m) (1 - product over i in m of (1 - x_i)): with x_i the
probability that filter i is applied, f is how many documents go. Its monomials' coefficients are sums of counts over
supersets. At a corner (every x_i 0 or 1) f is what the filters at 1 remove together, which gives the survivors after
each step of any order. A filter's Shapley value is the integral of df/dx_i along the diagonal; each power of t integrates
to a rational with denominator up to 5, so that 120 times the value, the sum over all orders, is an integer.

Defined results: null text is empty (it fails A alone, and E as any other copy); null source is the part ''; null doc_ids are
smaller than none and none is smaller than they: they never fail E, have no label and make nobody a copy; rows of one
doc_id and text are copies of smaller ids only, not of each other; a document with several labels is good, or toxic, if one of
them says so; an empty table has no part; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.core import SPACE_CHARS, materialize, worker
from recordloom.llm.sharding import group_key

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
SIGNS = "[#$%&*|]"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS)), " "), lambda w: w != "")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, key, mask) of every document; mask has the bits of A to D, which its own text decides."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("words", _words(F.col("text")))
    n = F.size("words")
    tests = [n < 200, 100 * F.size(F.array_distinct("words")) < 50 * n, 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"), F.col("text").rlike(SIGNS)]
    bits = sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", group_key(F.col("text")).alias("key"), bits.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and how many of them have these labels.

    A text's first id is the only document of it that E lets through: it is found by (key, doc_id), so that the copies of a
    text lie in as many partitions as they have ids.
    """
    rows = materialize(failures(docs), "audit")
    known = rows.where(F.col("doc_id").isNotNull())
    firsts = known.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda k: F.max((F.coalesce(F.col(k), F.lit(0)) == 1).cast("int")).alias(k)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality"), says("toxic"))
    judged = known.join(firsts, ["key", "doc_id"], "left").join(told, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    columns = ["part", "mask", "good", "bad"]
    judged = judged.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("bad"))
    others = rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("bad"))
    total = lambda c: F.sum(F.col(c).cast("long"))
    return judged.select(*columns).union(others).groupBy("part", "mask").agg(F.count("*").alias("n"), total("good").alias("good"), total("bad").alias("toxic"))


def coefficients(counts: np.ndarray) -> np.ndarray:
    """Monomials of the removal polynomials: counts (parts, masks) -> coefficients (parts, sets of variables)."""
    sets = np.arange(MASKS)
    bits = np.bitwise_count(sets)
    signs = np.where((sets[:, None] & sets) == sets[:, None], np.where(bits % 2, 1, -1)[:, None], 0)  # [set, mask]: mask holds set
    signs[0] = 0
    return counts @ signs.T


def corners(f: np.ndarray) -> np.ndarray:
    """f at every corner: a monomial is 1 where all its variables are."""
    sets = np.arange(MASKS)
    return f @ ((sets[:, None] & sets) == sets[:, None]).astype(np.int64)


def shapley(f: np.ndarray) -> np.ndarray:
    """(parts, filters): 120 times the integral over t of df/dx_i at x = (t, ..., t)."""
    bits = np.bitwise_count(np.arange(MASKS))
    out = np.zeros((len(f), len(FILTERS)), np.int64)
    for i in range(len(FILTERS)):
        for power in range(len(FILTERS)):  # of t, in the derivative: from monomials with one variable more
            term = f[:, (np.arange(MASKS) >> i & 1 == 1) & (bits == power + 1)].sum(axis=1)
            scaled = Fraction(factorial(len(FILTERS)), power + 1)  # the integral of t^power, times 120
            out[:, i] += term * scaled.numerator // scaled.denominator
    return out


def _steps(batches):
    letters = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    after = np.bitwise_or.accumulate(1 << letters, axis=1)
    i, after, before = letters.ravel(), after.ravel(), (after - (1 << letters)).ravel()
    size = len(i)
    order, step = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    everything = MASKS - 1
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    for batch in batches:
        parts = batch["part"].to_pylist()
        for a in range(0, len(parts), 50):
            own = parts[a : a + 50]
            counts = np.zeros((3, len(own), MASKS), np.int64)
            for p, cells in enumerate(batch["cells"][a : a + 50].to_pylist()):
                for cell in cells:
                    counts[:, p, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
            f = coefficients(counts[0])
            gone, good, toxic = corners(f), corners(coefficients(counts[1])), corners(coefficients(counts[2]))
            removed = gone[:, after] - gone[:, before]
            fails, unique = gone[:, 1 << i], (gone[:, [everything]] - gone[:, everything ^ 1 << np.arange(len(FILTERS))])[:, i]
            numbers = (counts[0].sum(axis=1)[:, None] - gone[:, after], removed, fails - removed, unique, good[:, after] - good[:, before], toxic[:, after] - toxic[:, before], shapley(f)[:, i])
            yield pa.RecordBatch.from_arrays([pa.array([x for x in own for _ in range(size)], pa.string()), pa.array(np.tile(order, len(own)).tolist(), pa.string()), pa.array(np.tile(step, len(own))), *[pa.array(x.ravel(), pa.int64()) for x in numbers]], names=names)


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, of mask_counts."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 of a part at most
    return cells.mapInArrow(worker(_steps), "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))

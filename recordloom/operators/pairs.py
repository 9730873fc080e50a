"""Features of candidate pairs (rec, s1): strings, sets, numbers, legal forms, frequencies; and of tentative clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.ids import source_of
from recordloom.functions.similarity import SCORERS, contains_either, jaccard, levenshtein_similarity, several
from recordloom.functions.text import words

NORM = ("core", "legal", "glued", "atok", "anum", "post", "indic")
#: Maps of token weights that pair_features puts beside them.
WEIGHTS = ("_n", "_a")


def with_sides(pairs: DataFrame, norm: DataFrame, left: str = "s1", right: str = "rec") -> DataFrame:
    """a_* of the left id and b_* of the right id; a missing record has empty texts."""
    cols = [c for c in (*NORM, *WEIGHTS) if c in norm.columns]
    side = lambda p, key: norm.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    out = pairs.join(side("a", left), left, "left").join(side("b", right), right, "left")
    return out.fillna("", [f"{p}_{c}" for p in "ab" for c in cols if c not in ("indic", *WEIGHTS)])


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def cheap_features(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """hn_eq (first house numbers equal; 0.5 if one lacks), glued_eq, src."""
    lean = norm.select("id", F.col("anum"), F.col("glued"))
    rows = with_sides(pairs, lean)
    a, b = F.get(words(F.col("a_anum")), F.lit(0)), F.get(words(F.col("b_anum")), F.lit(0))
    out = rows.withColumns({"hn_eq": F.when(a.isNull() | b.isNull(), 0.5).otherwise((a == b).cast("double")), "glued_eq": _flag(F.col("a_glued") == F.col("b_glued")), "src": source_of(F.col("rec"))})
    return out.drop("a_anum", "a_glued", "b_anum", "b_glued")


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two number arrays; -1 where either is empty."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    a0, b0 = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    x, y = a0.try_cast("double"), b0.try_cast("double")
    gap = F.abs(x - y)
    or_none = lambda c: F.when(none, -1.0).otherwise(F.coalesce(c.cast("double"), F.lit(-1.0)))
    return {
        "h_first_eq": or_none(a0 == b0), "h_b0_in_a": or_none(F.array_contains(a, F.coalesce(b0, F.lit("")))), "h_jac": jaccard(a, b, -1.0),
        "h_diff": or_none(F.least(gap, F.lit(1000.0)) / 1000), "h_rel": or_none(F.least(gap / F.greatest(x, F.lit(1.0)), F.lit(10.0))),
        "h_n_s1": F.size(a).cast("double"), "h_n_rec": F.size(b).cast("double"),
    }


def legal_features(a: Column, b: Column) -> dict[str, Column]:
    added, dropped = F.size(F.array_except(b, a)), F.size(F.array_except(a, b))
    conflict = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)
    return {"l_eq": ((added == 0) & (dropped == 0)).cast("double"), "l_added": added.cast("double"), "l_dropped": dropped.cast("double"), "l_conflict": conflict.cast("double")}


def idf_table(reference: DataFrame, column: str) -> tuple[DataFrame, float]:
    """(token, idf) over reference records, and the idf of a token none has."""
    import math

    n = max(reference.count(), 1)
    tokens = reference.select("id", F.explode(F.array_distinct(words(F.col(column)))).alias("token"))
    return tokens.groupBy("token").agg(F.log(1 + F.lit(n) / F.count("*")).alias("idf")), math.log(1 + n)


def token_weights(norm: DataFrame, column: str, idf: DataFrame, default: float, name: str) -> DataFrame:
    """norm with a map of each record's distinct tokens to their weights: tokens join their weights by key (that table may be
    large) once per record, whatever the number of its pairs."""
    tokens = norm.select("id", F.explode(F.array_distinct(words(F.col(column)))).alias("token"))
    weighted = tokens.join(idf, "token", "left").fillna(default, ["idf"])
    own = weighted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias(name))
    return norm.join(own, "id", "left")


def weighted_overlap(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """<prefix>_wov, _cov_s1, _cov_rec of two maps of token weights: weight of common tokens over the union's, the left's and the
    right's; -1 if either is empty."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    x, y = total(F.map_values(a)), total(F.map_values(b))
    common = F.aggregate(F.array_intersect(F.map_keys(a), F.map_keys(b)), F.lit(0.0), lambda acc, t: acc + F.element_at(a, t))
    some = a.isNotNull() & b.isNotNull() & (x > 0) & (y > 0)
    ratio = lambda c: F.when(some, common / c).otherwise(-1.0)
    return {f"{prefix}_wov": ratio(x + y - common), f"{prefix}_cov_s1": ratio(x), f"{prefix}_cov_rec": ratio(y)}


def pair_features(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """The full feature table of pruned candidates; norm holds reference (src 1) and other records."""
    s1, weighted = norm.where("src = 1"), norm
    for col, name in (("core", "_n"), ("atok", "_a")):
        weighted = token_weights(weighted, col, *idf_table(s1, col), name)
    rows = with_sides(pairs, weighted)
    a, b = lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")
    rows = rows.withColumns({
        "_core": several("ratio", "token_set_ratio", "token_sort_ratio", "partial_ratio")(a("core"), b("core")), "_atok": several("token_set_ratio", "ratio", "partial_token_set_ratio")(a("atok"), b("atok")),
        "_glued": SCORERS["jaro_winkler"](a("glued"), b("glued")),
    })
    post_a, post_b = words(a("post")), words(b("post"))
    feats = {
        "n_ratio": F.col("_core.ratio"), "n_tset": F.col("_core.token_set_ratio"), "n_tsort": F.col("_core.token_sort_ratio"), "n_partial": F.col("_core.partial_ratio"),
        **weighted_overlap(a("_n"), b("_n"), "n"), **weighted_overlap(a("_a"), b("_a"), "a"), "g_jw": F.col("_glued"), "g_lev": F.levenshtein(a("glued"), b("glued")).cast("double"),
        "g_eq": _flag(a("glued") == b("glued")), "g_contain": contains_either(a("glued"), b("glued")),
        "n_jac": jaccard(words(a("core")), words(b("core")), -1.0), "n_ntok_s1": F.size(words(a("core"))).cast("double"), "n_ntok_rec": F.size(words(b("core"))).cast("double"),
        **legal_features(words(a("legal")), words(b("legal"))),
        "a_tset": F.col("_atok.token_set_ratio"), "a_ratio": F.col("_atok.ratio"), "a_partial": F.col("_atok.partial_token_set_ratio"),
        "a_jac": jaccard(words(a("atok")), words(b("atok")), -1.0), **number_features(words(a("anum")), words(b("anum"))),
        "post_eq": F.when((F.size(post_a) == 0) | (F.size(post_b) == 0), -1.0).otherwise(F.arrays_overlap(post_a, post_b).cast("double")),
        "a_empty_rec": ((b("atok") == "") & (b("anum") == "")).cast("double"), "indic_rec": _flag(b("indic")),
    }
    rows = rows.withColumns(feats)
    glued = s1.groupBy(F.col("glued").alias("a_glued")).agg(F.count("*").cast("double").alias("freq_glued"))
    first = s1.groupBy(F.split("core", " ")[0].alias("_first")).agg(F.count("*").cast("double").alias("freq_first"))
    rows = rows.join(glued, "a_glued", "left").withColumn("_first", F.split("a_core", " ")[0]).join(first, "_first", "left")
    return rows.fillna(0.0, ["freq_glued", "freq_first"]).drop("_first", "_core", "_atok", "_glued", *[f"{p}_{c}" for p in "ab" for c in (*NORM, *WEIGHTS)])


def extra_features(a: Column, b: Column) -> dict[str, Column]:
    """Normalised similarities of two texts, 0 where one is empty."""
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    gate = lambda c: F.when(some, c).otherwise(0.0)
    return {"lev": gate(levenshtein_similarity(a, b)), "osa": gate(SCORERS["osa_similarity"](a, b)), "lcs": gate(SCORERS["lcs_similarity"](a, b)), "jw": gate(SCORERS["jaro_winkler"](a, b))}


def decoy_features(a_number: Column, b_number: Column, a_legal: Column, b_legal: Column, name_similarity: Column) -> dict[str, Column]:
    """What a planted non-match looks like: same name, another house number, a legal form that was added."""
    changed = (a_number != "") & (b_number != "") & (a_number != b_number)
    added = F.size(F.array_except(words(b_legal), words(a_legal))) > 0
    return {"d_house_changed": _flag(changed), "d_legal_added": _flag(added), "d_both": _flag(changed & added), "d_same_name": _flag(changed & (name_similarity >= 0.95))}


def cluster_features(scored: DataFrame, norm: DataFrame, p: str = "p1", threshold: float = 0.5, block_rows: int = 1024) -> DataFrame:
    """Collective features: each candidate record against the other records tentatively given to its entity.

    A record belongs to the entities where it scores best, from the threshold up. Candidates meet members by entity;
    defaults: no members 0, mean probability -1, similarities -2.
    """
    from recordloom.operators.ranking import competition

    out = competition(scored, p)
    best = F.max(p).over(_by("rec"))
    members = scored.withColumn("_best", best).where((F.col(p) >= F.col("_best")) & (F.col(p) >= threshold)).select(F.col("rec").alias("m"), "s1", F.col(p).alias("pm"))
    out = out.join(members.groupBy("s1").agg(F.count("*").alias(f"{p}_s1n")), "s1", "left").fillna(0, [f"{p}_s1n"])
    # both sides get their texts before they meet, so pairs aren't shuffled; an entity's members are dealt to blocks
    lean = norm.select("id", "core", "glued", "atok", "anum", "legal")
    side = lambda d, key, p: d.join(lean.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in lean.columns[1:]]), key, "left").fillna("", [f"{p}_{c}" for c in lean.columns[1:]])
    blocks = members.groupBy("s1").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_nb"))
    near = side(members, "m", "b").join(blocks, "s1").withColumn("_block", F.pmod(F.xxhash64("m"), "_nb").cast("int")).drop("_nb")
    asked = side(scored.select("rec", "s1"), "rec", "a").join(blocks, "s1").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb")
    both = asked.join(near, ["s1", "_block"]).where("m <> rec")
    ha, hb = F.get(words(F.col("a_anum")), F.lit(0)), F.get(words(F.col("b_anum")), F.lit(0))
    sims = both.select(
        "rec", "s1", "m", "pm", SCORERS["token_set_ratio"](F.col("a_core"), F.col("b_core")).alias("cn"), SCORERS["jaro_winkler"](F.col("a_glued"), F.col("b_glued")).alias("cg"),
        SCORERS["token_set_ratio"](F.col("a_atok"), F.col("b_atok")).alias("ca"), F.when(ha.isNull() | hb.isNull(), -1.0).otherwise((ha == hb).cast("double")).alias("ch"), (F.col("a_legal") == F.col("b_legal")).cast("double").alias("cl"),
    )
    same = (source_of(F.col("m")) == source_of(F.col("rec"))).cast("long")
    agg = sims.groupBy("rec", "s1").agg(
        F.count("*").alias("cl_n"), F.sum(same).alias("cl_same_src"), F.avg("pm").alias("cl_pmean"), F.max("cn").alias("cl_name_max"), F.avg("cn").alias("cl_name_mean"),
        F.max("cg").alias("cl_glued_max"), F.max("ca").alias("cl_addr_max"), F.avg("ca").alias("cl_addr_mean"), F.avg("ch").alias("cl_hn_agree"), F.max("ch").alias("cl_hn_any"), F.avg("cl").alias("cl_legal_agree"),
    )
    out = out.join(agg, ["rec", "s1"], "left")
    similar = ["cl_name_max", "cl_name_mean", "cl_glued_max", "cl_addr_max", "cl_addr_mean", "cl_hn_agree", "cl_hn_any", "cl_legal_agree"]
    return out.fillna(0, ["cl_n", "cl_same_src"]).fillna(-1.0, ["cl_pmean"]).fillna(-2.0, similar)


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)

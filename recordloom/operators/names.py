"""Repair of noisy names: cleaning rules, word segmentation, OCR digits, noisy-channel tokens, transliteration caches.

Vocabulary-driven repairs work on the distinct tokens and join back, so their cost follows the vocabulary.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordloom.functions.text import ALIASES, SCRIPTS, dominant_script, fold_ascii, join_initials, literal_map, skeleton, squeeze, words

# ---- fixed values -------------------------------------------------------------------------------------------------
TITLES = ("mr", "mrs", "ms", "dr", "shri", "smt", "m s", "the")
#: What a scanner may have read in place of a character.
OCR = {"0": "o", "1": "li", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "l": "i", "i": "l"}
#: Digit and letter that noise exchanges.
OCR_PAIRS = (("o", "0"), ("s", "5"), ("b", "8"), ("l", "1"), ("i", "1"), ("g", "6"), ("e", "3"), ("a", "4"), ("t", "7"), ("z", "2"))
STOPWORDS = ("the", "of", "and", "&", "ms", "dba")
ABBREVIATIONS = {"pvt": "private", "ltd": "limited", "co": "company", "corp": "corporation", "intl": "international", "mfg": "manufacturing", "bros": "brothers", "assoc": "associates", "&": "and"}
LEGAL_WORDS = (
    "pvt", "private", "ltd", "limited", "llp", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "pty", "gmbh", "ag", "kg", "ug", "sa", "sarl",
    "srl", "sl", "slu", "nv", "bv", "oy", "ab", "spa", "kft", "zrt", "oyj", "asa", "aps", "sas", "sasu", "eurl", "sce", "scop", "sro", "kk", "gk", "yugen", "opc",
    "pllc", "lp", "pc", "ei", "snc", "sci", "scp", "scm", "sca", "gie", "selarl", "ets",
)
# -------------------------------------------------------------------------------------------------------------------


def clean_name(name: Column) -> Column:
    """Alias tails, www and domain tails, titles and M/s taken off a normalised name."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"^.*?{ALIASES}\s*(?=\S)", "")
    s = F.regexp_replace(s, r"^www[ .]|[ .](?:com|net|org|in|fr|biz)$", "")
    s = F.regexp_replace(s, r"\bm/s\b\.?", " ")
    return squeeze(F.regexp_replace(squeeze(s), rf"^(?:(?:{'|'.join(TITLES)})\.? )+", ""))


def _without_ids(t: Column) -> Column:
    """Numbers of four digits and more are record ids, and so is an 'id' or 'no' before one; a name of nothing else stays."""
    number = lambda w: F.coalesce(w.rlike(r"^\d{4,}$"), F.lit(False))
    rest = F.filter(t, lambda w, i: ~number(w) & ~(w.isin("id", "no") & number(F.get(t, i + 1))))
    return F.when(F.size(rest) > 0, rest).otherwise(t)


def canonical_keys(name: Column) -> Column:
    """struct<c4a, c4b, legal>: initials joined, abbreviations written out and record ids dropped (c4a); then without the legal
    words at the end (legal), stop words and other legal words (c4b), unless nothing would be left."""
    short = literal_map(ABBREVIATIONS)
    tokens = words(join_initials(F.trim(F.lower(F.coalesce(name, F.lit(""))))))
    full = _without_ids(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(short, w), w)))

    def keys(t: Column) -> Column:
        # how many words there are up to the last one that isn't a legal form
        kept = F.coalesce(F.array_max(F.transform(t, lambda x, i: F.when(~x.isin(*LEGAL_WORDS), i + 1))), F.lit(0))
        head = F.filter(t, lambda x, i: (i < kept) & ~x.isin(*STOPWORDS))
        bare = F.filter(head, lambda x: ~x.isin(*LEGAL_WORDS))
        core = F.when(F.size(bare) > 0, bare).when(F.size(head) > 0, head).otherwise(t)
        return F.struct(F.array_join(t, " ").alias("c4a"), F.array_join(core, " ").alias("c4b"), F.array_join(F.filter(t, lambda x, i: i >= kept), " ").alias("legal"))

    return F.transform(F.array(full), keys)[0]


def per_distinct(df: DataFrame, column: str, fn, name: str) -> DataFrame:
    """fn applied once per distinct value and joined back (null stays null)."""
    done = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, fn(F.col(column)))
    return df.join(done, column, "left")


def token_table(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(words(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("count"))


def _apply(df: DataFrame, column: str, fixes: DataFrame, name: str, key: str = "id") -> DataFrame:
    """column with tokens replaced by (token, fixed), order kept; key identifies rows."""
    parts = df.select(key, F.posexplode_outer(words(F.col(column))).alias("pos", "token")).join(fixes, "token", "left")
    back = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "token", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias(name))
    return df.join(back, key, "left")


def ocr_fixes(tokens: DataFrame, vocabulary: DataFrame, most: int = 256) -> DataFrame:
    """(token, fixed): characters exchanged for what they may have been, where one variant is known; the most frequent wins.

    Only unknown tokens of three characters and more with a digit, an l or an i; numbers and tokens with two digits in a row
    (model numbers) stay, and so do tokens of more than `most` variants."""
    odd = tokens.select("token").where((F.length("token") >= 3) & F.col("token").rlike("[0-9li]") & ~F.col("token").rlike(r"^\d+$|\d\d"))
    odd = odd.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    ways = F.aggregate(F.split("token", ""), F.lit(1.0), lambda n, ch: n * F.coalesce(*[F.when(ch == k, F.lit(1.0 + len(v))) for k, v in OCR.items()], F.lit(1.0)))

    def step(acc: Column, ch: Column) -> Column:
        options = F.coalesce(*[F.when(ch == k, F.array(ch, *[F.lit(c) for c in v])) for k, v in OCR.items()], F.array(ch))
        return F.flatten(F.transform(acc, lambda head: F.transform(options, lambda c: F.concat(head, c))))

    grown = F.aggregate(F.split("token", ""), F.array(F.lit("")), step)
    variants = odd.where(ways <= most).select("token", F.explode(grown).alias("word")).where("word <> token")
    return variants.join(vocabulary, "word").groupBy("token").agg(F.min_by("word", F.struct(-F.col("count"), F.col("word"))).alias("fixed"))


def fix_ocr(df: DataFrame, column: str, vocabulary: DataFrame, name: str, key: str = "id") -> DataFrame:
    return _apply(df, column, ocr_fixes(token_table(df, column), vocabulary), name, key)


def undoubled(value: Column) -> Column:
    return F.regexp_replace(value, r"(.)\1+", "$1")


def noise_cost(noisy: Column, clean: Column) -> Column:
    """How unlikely noise makes one word of another: doubled letters 0.3, one or two exchanged look-alikes 0.3 each, two
    neighbours swapped 0.5, else the number of edits."""
    apart = F.filter(F.zip_with(F.split(noisy, ""), F.split(clean, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"] != p["y"])
    alike = lambda p: F.concat(p["x"], p["y"]).isin(*[a + b for a, b in OCR_PAIRS], *[b + a for a, b in OCR_PAIRS])
    same = F.length(noisy) == F.length(clean)
    place = F.array_min(F.filter(F.transform(F.split(noisy, ""), lambda x, i: F.when(x != F.get(F.split(clean, ""), i), i)), lambda i: i.isNotNull()))
    swapped = (F.size(apart) == 2) & (F.substr(noisy, place + 1, F.lit(2)) == F.reverse(F.substr(clean, place + 1, F.lit(2))))
    return (
        F.when(noisy == clean, 0.0).when(undoubled(noisy) == undoubled(clean), 0.3)
        .when(same & (F.size(apart) <= 2) & F.forall(apart, alike), 0.3 * F.size(apart)).when(same & swapped, 0.5).otherwise(F.levenshtein(noisy, clean).cast("double"))
    )


def _deleted(word: Column, most: Column) -> Column:
    """The word and what is left of it with one or two letters taken out (two only where most is 2): words within so many
    edits of each other have one of these in common."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    once = without(word)
    return F.array_distinct(F.concat(F.array(word), once, F.when(most >= 2, F.flatten(F.transform(once, without))).otherwise(F.array().cast("array<string>"))))


def token_repairs(tokens: DataFrame, vocabulary: DataFrame, rate: float = 0.15, margin: float = 0.3, least: int = 1) -> DataFrame:
    """(token, fixed): unknown tokens to the word of least noise cost less rate * ln(count), if the next best is `margin` worse
    and the cost at most 1 (2 from eight letters on).

    Candidates are words of `least` occurrences that are the same but for doubled letters, or within two edits: they meet on
    what deletions leave of both, so a token meets few words however large the vocabulary is."""
    odd = tokens.select("token").where((F.length("token") >= 4) & ~F.col("token").rlike(r"^\d+$")).join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    known = vocabulary.where((F.col("count") >= least) & (F.length("word") >= 3) & F.col("word").rlike(r"^\p{L}+$"))
    near = lambda c: F.concat(F.transform(_deleted(F.col(c), F.lit(2)), lambda x: F.concat(F.lit("d"), x)), F.array(F.concat(F.lit("u"), undoubled(F.col(c)))))
    pairs = odd.select("token", F.explode(near("token")).alias("_k")).join(known.select("word", "count", F.explode(near("word")).alias("_k")), "_k").select("token", "word", "count").distinct()
    edits = F.levenshtein("token", "word")
    pairs = pairs.where((undoubled(F.col("token")) == undoubled(F.col("word"))) | (edits <= 2)).withColumn("_noise", noise_cost(F.col("token"), F.col("word")))
    scored = pairs.withColumn("cost", F.col("_noise") - rate * F.log("count"))
    w = Window.partitionBy("token").orderBy("cost", "word")
    best = scored.withColumns({"_n": F.row_number().over(w), "_next": F.lead("cost").over(w)})
    sure = F.col("_noise") <= F.when(F.length("token") < 8, 1.0).otherwise(2.0)
    return best.where((F.col("_n") == 1) & sure & (F.coalesce(F.col("_next"), F.lit(1e9)) - F.col("cost") >= margin)).select("token", F.col("word").alias("fixed"))


def repair_tokens(df: DataFrame, column: str, vocabulary: DataFrame, name: str, key: str = "id") -> DataFrame:
    return _apply(df, column, token_repairs(token_table(df, column), vocabulary), name, key)


def segmentations(tokens: DataFrame, vocabulary: DataFrame, least: int = 6) -> DataFrame:
    """(token, fixed): unknown tokens of `least` letters and more cut into words of two letters and more, where that is possible: the
    cut of least summed cost, a word's being -ln(count / all counts); of equally good ones, that whose last word is longest.

    The vocabulary may be of any size: each distinct token's substrings meet it by key, and the token's own hits, at most one
    per pair of places, are walked once.
    """
    total, longest = vocabulary.agg(F.coalesce(F.sum("count"), F.lit(1)), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
    glued = tokens.select("token").where(F.length("token") >= least).distinct().join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    starts = glued.select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("start"))
    room = F.least(F.length("token") - F.col("start") + 1, F.lit(longest))
    pieces = starts.where(room >= 2).select("token", "start", F.explode(F.sequence(F.lit(2), room)).alias("size"))
    pieces = pieces.withColumn("word", F.substr("token", F.col("start"), F.col("size")))
    found = pieces.join(vocabulary, "word").withColumn("cost", -F.log(F.col("count") / F.lit(total)))
    by_end = F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("size") - 1).alias("end"), F.col("start").alias("start"), F.col("cost").alias("cost"))))
    return found.groupBy("token").agg(by_end.alias("hits")).select("token", _cut("token", "hits").alias("fixed")).where(F.col("fixed") != F.col("token"))


@F.pandas_udf(StringType())
def _cut(tokens: pd.Series, hits: pd.Series) -> pd.Series:
    """Each token by its hits (end, start, cost), ends ascending."""
    out = []
    for token, own in zip(tokens, hits, strict=True):
        best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
        for h in own:
            if h["start"] - 1 in best:
                now = (best[h["start"] - 1][0] + h["cost"], h["start"] - 1)
                best[h["end"]] = min(best.get(h["end"], (math.inf, 0)), now)
        parts, end = [], len(token) if len(token) in best else 0
        while end:
            parts.append(token[best[end][1] : end])
            end = best[end][1]
        out.append(" ".join(reversed(parts)) or token)
    return pd.Series(out)


def segment(df: DataFrame, column: str, vocabulary: DataFrame, name: str, key: str = "id") -> DataFrame:
    """column with glued words cut, as name."""
    return _apply(df, column, segmentations(token_table(df, column), vocabulary), name, key)


def language_info(df: DataFrame, column: str, languages: dict[str, str] | None = None) -> DataFrame:
    """script and language of each text: by script, and null where a script has several languages."""
    table = languages or {"Devanagari": None, "Bengali": "bn", "Gurmukhi": "pa", "Gujarati": "gu", "Oriya": "or", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Malayalam": "ml", "Latin": "en"}
    script = dominant_script(F.col(column))
    lang = F.coalesce(*[F.when(F.col("script") == k, F.lit(v)) for k, v in table.items() if v])
    return df.withColumn("script", script).withColumn("lang", lang)


def resolve_language(script_language: Column, predicted: Column, confidence: Column, allowed: Column, least: float = 0.5) -> Column:
    """A model's language if it is sure and fits the script, else the script's own."""
    return F.when((confidence >= least) & F.array_contains(allowed, predicted), predicted).otherwise(script_language)


def romanize(df: DataFrame, column: str, cache: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Tokens of other scripts by the cache (token, roman); unknown ones stay."""
    return _apply(df, column, cache.select("token", F.col("roman").alias("fixed")), name, key)


OTHER_SCRIPTS = tuple(k for k in SCRIPTS if k != "Latin")
_RUNS = "|".join(rf"\p{{Is{k}}}+" for k in OTHER_SCRIPTS) + "|[^" + "".join(rf"\p{{Is{k}}}" for k in OTHER_SCRIPTS) + "]+"


def script_runs(value: Column) -> Column:
    """A text's runs of one script, in order; Latin letters, digits and signs together are a run."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(_RUNS), 0)


def romanize_runs(df: DataFrame, column: str, cache: DataFrame, model: DataFrame | None, name: str, key: str = "id") -> DataFrame:
    """column in Latin letters as name, and where each run of another script came from as <name>_sources, in order: the cache
    (token, roman), else the model's table of the same columns, else its sound (letter by letter). No other script is left.

    Every distinct run is looked up once; rows and runs meet by key.
    """
    runs = F.posexplode_outer(script_runs(F.col("_w"))).alias("_r", "token")
    parts = df.select(key, F.posexplode_outer(words(F.col(column))).alias("_p", "_w")).select(key, "_p", runs)
    other = parts.select("token").where(F.col("token").rlike("|".join(rf"\p{{Is{k}}}" for k in OTHER_SCRIPTS))).distinct()
    known = other.join(cache.select("token", F.col("roman").alias("_c")), "token", "left")
    known = known.join(model.select("token", F.col("roman").alias("_m")), "token", "left") if model is not None else known.withColumn("_m", F.lit(None).cast("string"))
    source = F.when(F.col("_c").isNotNull(), "cache").when(F.col("_m").isNotNull(), "model").otherwise("sound")
    found = known.select("token", F.coalesce("_c", "_m", fold_ascii(F.col("token"))).alias("_roman"), source.alias("_s"))
    spelt = parts.join(found, "token", "left")
    own = F.array_sort(F.collect_list(F.struct("_p", "_r", F.coalesce("_roman", "token", F.lit("")).alias("t"), "_s")))
    each = spelt.groupBy(key).agg(own.alias("_o"))
    text = F.aggregate("_o", F.lit(""), lambda acc, x: F.concat(acc, F.when((x["_r"] == 0) & (x["_p"] > 0), F.lit(" ")).otherwise(F.lit("")), x["t"]))
    sources = F.transform(F.filter("_o", lambda x: x["_s"].isNotNull()), lambda x: x["_s"])
    return df.join(each.select(key, text.alias(name), sources.alias(f"{name}_sources")), key, "left")


def missing_tokens(df: DataFrame, column: str, cache: DataFrame) -> DataFrame:
    other = "|".join(rf"\p{{Is{s}}}" for s in SCRIPTS if s != "Latin")
    return token_table(df, column).where(F.col("token").rlike(other)).join(cache.select("token"), "token", "left_anti")


def snap_to_vocabulary(cache: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, roman): phonetic spellings moved to a known word of the same skeleton with a ratio of 80 or more."""
    from recordloom.functions.similarity import SCORERS

    a = cache.withColumn("_sk", skeleton(F.col("roman")))
    v = vocabulary.select("word", "count", skeleton(F.col("word")).alias("_sk"))
    near = a.join(v, "_sk").withColumn("_r", SCORERS["ratio"](F.col("roman"), F.col("word"))).where("_r >= 80")
    best = near.groupBy("token").agg(F.max_by("word", F.struct("_r", "count", "word")).alias("_best"))
    return cache.join(best, "token", "left").select("token", F.coalesce("_best", "roman").alias("roman"))

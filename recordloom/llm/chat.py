"""Chat formatting into budgeted training windows. DataFrame functions only.

A turn is written as ``[INST role] text [/INST]</s>``, with control strings in role and text escaped reversibly, and its
token count is estimated as words plus punctuation marks and 4 for the marks around it. Each window starts with the
conversation's leading system turn, repeats up to ``history`` tokens of the last turns of the window before, and has room for
what the budget leaves: new turns, chosen by prefix sums of turn tokens. The sums are cut at every multiple of that room; the
turns between two cuts are a window, and a turn that a cut goes through is one of its own unless it still fits. So a
window keeps to ``budget`` tokens, but where a turn alone is longer than the room, or where the system turn and the history
leave less than a quarter of the budget (a quarter is then the room). The loss mask holds each assistant text only where it
is new, so repeated targets are masked.

Output, one row per window: conv_id, window_id, formatted, n_tokens, spans: array<struct<begin, length, role, fresh,
loss>> in code points of ``formatted``; begin and length give the escaped text of a turn.

Defined results: null text and role are empty; turns are ordered by (turn, role, text), so ties and repeated rows stay;
null conv_id is a conversation of its own; a turn above the budget gets a window of its own, uncut; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST ", "] ", " [/INST]</s>"
BUDGET = 512
HISTORY = 128


def escape(text: Column) -> Column:
    """Double backslashes and put one inside every control string, so that none is left in the text."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"<(?=/?s>)|\[(?=/?INST)", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 4


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    before = conv.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tokens", n_tokens(F.col("text")).cast("long")).withColumn("pos", F.row_number().over(conv))
    lead = (F.col("pos") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("lead", lead).withColumn("cost", F.when(F.col("lead"), 0).otherwise(F.col("tokens")))
    rows = rows.withColumn("start", F.coalesce(F.sum("cost").over(before), F.lit(0)))
    rows = rows.withColumn("stop", F.col("start") + F.col("cost"))
    # the room for new turns, and between which of its multiples a turn begins
    whole = Window.partitionBy("conv_id")
    taken = F.coalesce(F.max(F.when(F.col("lead"), F.col("tokens"))).over(whole), F.lit(0))
    rows = rows.withColumn("room", F.greatest(F.lit(budget - history) - taken, F.lit(max(1, budget // 4))))
    rows = rows.withColumn("home", F.when(F.col("lead"), F.lit(0).cast("long")).otherwise(F.floor(F.col("start") / F.col("room"))))
    # the turn that the next cut goes through stands apart if it doesn't fit beside those before it
    beside = F.sum("cost").over(Window.partitionBy("conv_id", "home"))
    apart = ~F.col("lead") & (F.col("stop") > (F.col("home") + 1) * F.col("room")) & (beside > F.col("room"))
    rows = rows.withColumn("cut", 2 * F.col("home") + apart.cast("long"))
    # gaps (a turn over several cuts) are closed, so window ids count from 0
    rows = rows.withColumn("window_id", F.dense_rank().over(Window.partitionBy("conv_id").orderBy("cut")) - 1)
    turn = F.struct(F.col("pos"), F.col("role"), F.regexp_replace(escape(F.col("role")), r"\](?= )", r"$0\\").alias("shown"), escape(F.col("text")).alias("said"), F.col("tokens"), F.col("stop"))
    by_window = rows.groupBy("conv_id", "window_id").agg(F.sort_array(F.collect_list(turn)).alias("new"), F.min("start").alias("from_token"), F.first(F.when(F.col("lead"), turn), ignorenulls=True).alias("own_system"))
    # what the window before can lend: its turns that begin within the last `history` tokens
    w = Window.partitionBy("conv_id").orderBy("window_id")
    by_window = by_window.withColumn("lent", F.lag("new").over(w)).withColumn("system", F.first("own_system", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    old = F.filter(F.coalesce("lent", F.array().cast(by_window.schema["new"].dataType)), lambda x: (x["stop"] - x["tokens"] >= F.col("from_token") - history) & ~(F.coalesce(x["pos"] == F.col("system.pos"), F.lit(False))))
    tagged = lambda turns, fresh: F.transform(turns, lambda x: F.struct(x["role"].alias("role"), x["shown"].alias("shown"), x["said"].alias("said"), x["tokens"].alias("tokens"), F.lit(fresh).alias("fresh")))
    head = F.when((F.col("window_id") > 0) & F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast(by_window.schema["new"].dataType))
    out = by_window.select("conv_id", "window_id", F.concat(tagged(head, False), tagged(old, False), tagged(F.col("new"), True)).alias("turns"))
    return out.select(
        "conv_id",
        F.col("window_id").cast("long").alias("window_id"),
        F.array_join(F.transform("turns", lambda x: F.concat(F.lit(OPEN), x["shown"], F.lit(CLOSE), x["said"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("n_tokens"),
        _spans(F.col("turns")).alias("spans"),
    )


def _spans(turns: Column) -> Column:
    empty = F.array().cast("array<struct<begin:long,length:long,role:string,fresh:boolean,loss:boolean>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc, x):
        begin = acc["at"] + len(OPEN) + F.length(x["shown"]) + len(CLOSE)
        length = F.length(x["said"]).cast("long")
        span = F.struct(begin.alias("begin"), length.alias("length"), x["role"].alias("role"), x["fresh"].alias("fresh"), (x["fresh"] & (x["role"] == "assistant")).alias("loss"))
        return F.struct((begin + length + len(END)).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def read_turns(windows: DataFrame) -> DataFrame:
    """windows with turns: array<struct<role, text, fresh, loss>> as the formatted text has them."""
    pieces = F.regexp_extract_all("formatted", F.lit(r"(?s)\[INST (.*?)\] (.*?) \[/INST\]</s>"), 0)
    part = lambda piece, k: unescape(F.regexp_extract(piece, r"(?s)\A\[INST (.*?)\] (.*) \[/INST\]</s>\z", k))
    span = lambda i: F.get(F.col("spans"), i)
    return windows.withColumn("turns", F.transform(pieces, lambda p, i: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text"), span(i)["fresh"].alias("fresh"), span(i)["loss"].alias("loss"))))


def read_back(windows: DataFrame) -> DataFrame:
    """The turns as the formatted text has them: conv_id, window_id, nth, role, text, fresh, loss."""
    return read_turns(windows).select("conv_id", "window_id", F.posexplode("turns").alias("nth", "turn")).select("conv_id", "window_id", "nth", "turn.*")

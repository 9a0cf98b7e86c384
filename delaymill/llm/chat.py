"""Operator 7: chat formatting in budgeted windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaymill.operators.ranking import running_totals

BUDGET = 2048
HISTORY = 512
LEAST_PART = 8  # of the budget an eighth at least is for new turns, as far as the system turn leaves it
TURN_TOKENS = 4  # of the template around a turn
START, END = "<|im_start|>", "<|im_end|>\n"
TARGET = "assistant"


def count_tokens(text: Column) -> Column:
    """Words and single marks; pass another expression for a tokenizer's own count."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def escape(text: Column) -> Column:
    """No ``<|`` is left: every ``<``, backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Backslash, line break and bar as two-letter codes, so that a role is one line without control strings."""
    for plain, code in (("\\", "\\b"), ("\n", "\\n"), ("|", "\\p")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("|", "\\p"), ("\n", "\\n"), ("\\", "\\b")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens) -> DataFrame:
    """conv_id, window, n_repeated, n_tokens, formatted and loss (array of start, end) of every window.

    Prefix sums of the turns' tokens place the turns: the tokens are cut into stretches of what system turn and history leave of the
    budget, a turn inside a stretch joins the window of that stretch, and a turn that crosses an end is a window of its own. Each window
    begins with the conversation's leading system turn and the whole turns that fit into ``history`` tokens before it, or into what a
    turn of its own leaves of the budget. So no window exceeds ``budget`` unless one turn and the system turn do.
    Every turn is new in one window only; the loss spans hold the (escaped) texts of new assistant turns.
    Prefix sums are made over slices of a conversation and only a stretch is ever gathered, so a
    very long conversation spreads over tasks. Null roles and texts are empty, rows of one turn number are ordered by
    role and text, null ids are one conversation, an empty table gives no windows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", (tokens(F.col("text")) + TURN_TOKENS).cast("long"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = running_totals(rows, ["conv_id"], order, {"tokens": "end"}).withColumn("start", F.col("end") - F.col("tokens"))
    system = placed.filter("start = 0 AND role = 'system'").select(
        F.col("conv_id").alias("_conv"), F.struct("role", "text", "tokens").alias("system")
    )
    placed = placed.join(system, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    room = F.greatest(F.lit(budget) - F.coalesce("system.tokens", F.lit(0)), F.lit(0)).cast("long")
    kept = F.greatest(F.least(F.lit(history), F.col("room") - budget // LEAST_PART), F.lit(0)).cast("long")
    placed = placed.withColumn("room", room).withColumn("history", kept)
    placed = placed.withColumn("stretch", F.greatest(F.col("room") - F.col("history"), F.lit(1)).cast("long"))
    first, last = (F.floor(F.col(c) / F.col("stretch")) for c in ("start", "final"))
    placed = placed.withColumn("final", F.col("end") - 1).select(
        "conv_id", "system", "room", "history", first.alias("own"), (first != last).alias("alone"), "start", "end", "role", "text", "stretch"
    )
    behind = (F.floor((F.col("start") + n) / F.col("stretch")) for n in (F.lit(1), F.greatest("history", F.lit(1))))
    seen_from = F.array_distinct(F.concat(F.array("own"), F.sequence(*behind)))
    turn = F.struct("start", "end", "role", "text", "alone")
    dealt = placed.select("conv_id", "system", "room", "history", turn.alias("turn"), "own", F.explode(seen_from).alias("at"))
    is_system = F.col("system").isNotNull() & (F.col("turn.start") == 0)
    gathered = dealt.groupBy("conv_id", "at").agg(
        F.first("system").alias("system"),
        F.first("room").alias("room"),
        F.first("history").alias("history"),
        F.sort_array(F.collect_list(F.when(F.col("own") == F.col("at"), F.col("turn")))).alias("new"),
        F.sort_array(F.collect_list(F.when(~is_system, F.col("turn")))).alias("past"),
    )
    split = F.array(F.filter("new", lambda t: ~t["alone"]), F.filter("new", lambda t: t["alone"]))
    each = gathered.select("conv_id", "system", "room", "history", "past", F.explode(F.filter(split, lambda w: F.size(w) > 0)).alias("new"))
    each = each.withColumn("window", F.col("new")[0]["start"]).withColumn("taken", _tokens("new"))
    back = F.least("history", F.col("room") - F.col("taken"))
    fits = lambda t: (t["end"] <= F.col("window")) & (t["start"] >= F.col("window") - back)
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    each = each.withColumn("past", F.filter("past", fits))
    again = F.when(F.col("window") > 0, F.coalesce("system.tokens", F.lit(0))).otherwise(0)
    each = each.withColumn("n_tokens", (F.col("taken") + _tokens("past") + again).cast("long"))
    lead = F.when(F.col("system").isNotNull() & (F.col("window") > 0), F.array(plain(F.col("system"))))
    lead = F.coalesce(lead, F.array().cast("array<struct<role:string,text:string>>"))
    each = each.select(
        "conv_id", "window", "n_tokens", F.concat(lead, F.transform("past", plain)).alias("old"), F.transform("new", plain).alias("new")
    )
    shown = lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == TARGET).alias("target"),
    )
    each = each.select(
        "conv_id", "window", "n_tokens", F.size("old").alias("n_repeated"), F.transform(F.concat("old", "new"), shown).alias("parts")
    )
    whole = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return each.select("conv_id", "window", "n_repeated", "n_tokens", whole.alias("formatted"), _spans().alias("loss"))


def _tokens(turns: str) -> Column:
    return F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"])


def _spans() -> Column:
    """Where the texts of new target turns begin and end in the formatted window."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, part):
        begin = state["at"] + F.length(part["head"])
        end = begin + F.length(part["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(part["target"] & part["new"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    marked = F.transform("parts", lambda p, i: F.struct(p["head"].alias("head"), p["body"].alias("body"), p["target"].alias("target"), (i >= F.col("n_repeated")).alias("new")))
    return F.aggregate(marked, empty, step, lambda s: s["spans"])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text) that are new in the window, and the unescaped texts under its loss mask."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn(piece):
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"), under.alias("targets"), F.length("formatted").cast("long").alias("chars")
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from what is read back: turns, their digest, and what lies under the loss mask."""
    per = read_back(formatted).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("windows"), F.sum("chars").alias("formatted_chars")
    )
    turns = F.flatten(F.transform("windows", lambda w: w["turns"]))
    per = per.select("conv_id", turns.alias("turns"), F.flatten(F.transform("windows", lambda w: w["targets"])).alias("targets"), "formatted_chars")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

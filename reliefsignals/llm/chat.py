"""Chat formatting into budgeted windows, with DataFrame functions only.

Every turn has a token count; prefix sums of the counts within a conversation choose spans of
whole turns. Each span becomes one window: the system turn first (the conversation's first
turn, if its role is ``system``), then a limited number of earlier tokens' turns repeated as
history, then the span's own turns. Texts of assistant turns of the span are the targets; those
repeated as history are masked, so each assistant text is a target exactly once.

With a budget ``B``, ``s`` tokens of the system turn and ``stride = (B - s) / 2``, a turn that
ends at prefix sum ``e`` belongs to span ``(e - 1) / stride``; a turn longer than the stride is
a span by itself. A window therefore stays within the budget, unless one turn with the system
turn exceeds it, which ``over_budget`` says: nothing is ever cut.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. Control strings inside texts
are taken apart by escapes that ``unescaped`` undoes; roles are URL-encoded.

Null texts and roles are empty. Turns are ordered by turn, role and text; a null turn comes
first, a null conversation is one conversation. Repeated rows are repeated turns. An empty
table gives no windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TARGET, SYSTEM = "assistant", "system"
BUDGET, HISTORY = 2048, 512
#: Tokens of a turn's markers and role.
MARKS = 4
#: Starts of control strings, of this template and of common others; fixed values.
CONTROL_ANGLE = r"<(?=\||/?s>|</?SYS>>)"
CONTROL_BRACKET = r"\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    r"""No control string is left: its first character becomes ``\l`` or ``\i``, and a backslash before b, l or i becomes ``\b``."""
    text = F.regexp_replace(text, r"\\(?=[bli])", r"\\b")
    return F.regexp_replace(F.regexp_replace(text, CONTROL_ANGLE, r"\\l"), CONTROL_BRACKET, r"\\i")


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit(r"\l"), F.lit("<")), F.lit(r"\i"), F.lit("["))
    return F.replace(text, F.lit(r"\b"), F.lit("\\"))


def token_estimate(text: Column) -> Column:
    """Words and marks, but at least a sixteenth of the bytes, so that a text without spaces counts."""
    pieces = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))
    return F.greatest(pieces, F.ceil(F.octet_length(text) / 16).cast("int"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """``conv_id, window, n_context, n_turns, tokens, over_budget, formatted, loss``.

    ``n_context`` counts the repeated turns at the start of ``formatted``; ``loss`` lists start
    (from 0) and length in code points of the target texts, as escaped.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw")
    ).withColumn("tokens", tokens(F.col("raw")).cast("long") + MARKS)
    rows = rows.withColumn("place", F.row_number().over(by_turn)).withColumn("system", (F.col("place") == 1) & (F.col("role") == SYSTEM))
    own = F.when(F.col("system"), 0).otherwise(F.col("tokens"))
    rows = rows.withColumn("before", F.max(F.when(F.col("system"), F.col("tokens"))).over(by_turn))
    rows = rows.withColumn("end", F.sum(own).over(by_turn.rowsBetween(Window.unboundedPreceding, 0)))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.coalesce("before", F.lit(0))) / 2))
    span = F.when(F.col("system"), -1).otherwise(F.floor((F.col("end") - 1) / stride))
    alone = F.when(F.col("tokens") > stride, F.col("place")).otherwise(0)
    rows = rows.withColumn("span", span).withColumn("alone", F.when(F.col("system"), 0).otherwise(alone))

    marked = F.struct(
        "place",
        F.concat(F.lit(TURN), F.url_encode("role"), F.lit(TEXT)).alias("head"),
        escaped(F.col("raw")).alias("body"),
        (F.col("role") == TARGET).alias("target"),
        "tokens",
    )
    spans = rows.groupBy("conv_id", "span", "alone").agg(
        F.sort_array(F.collect_list(marked)).alias("turns"), F.min("place").alias("first"), F.sum("tokens").alias("sum")
    )
    in_order = Window.partitionBy("conv_id").orderBy("first")
    spans = spans.withColumn("system", F.first(F.when(F.col("span") == -1, F.col("turns")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lag(F.when(F.col("span") != -1, F.col("turns"))).over(in_order)
    none = F.filter("turns", lambda t: F.lit(False))
    spans = spans.withColumn("last", F.coalesce(last, none)).withColumn("system", F.coalesce("system", none))
    alone_system = (F.col("span") == -1) & (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) == 1)
    spans = spans.withColumn("only", alone_system).filter((F.col("span") != -1) | F.col("only"))
    spans = spans.withColumn("system", F.when(F.col("only"), none).otherwise(F.col("system")))

    used = F.aggregate("system", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]) + F.col("sum")
    room = F.least(F.lit(history).cast("long"), F.lit(budget) - used)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(True).alias("on"))

    def take(state: Column, turn: Column) -> Column:
        fits = state["on"] & (state["n"] + turn["tokens"] <= F.col("room"))
        return F.struct(
            F.when(fits, state["n"] + turn["tokens"]).otherwise(state["n"]).alias("n"),
            F.when(fits, state["k"] + 1).otherwise(state["k"]).alias("k"),
            fits.alias("on"),
        )

    spans = spans.withColumn("used", used).withColumn("room", room)
    spans = spans.withColumn("back", F.aggregate(F.reverse("last"), start, take))
    kept = F.slice("last", F.size("last") - F.col("back")["k"] + 1, F.col("back")["k"])
    context = F.concat(F.col("system"), F.when(F.col("back")["k"] > 0, kept).otherwise(none))
    spans = spans.withColumn("context", context).withColumn("whole", F.concat("context", "turns"))

    def shown(turn: Column) -> Column:
        return F.concat(turn["head"], turn["body"], F.lit(END))

    lengths = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"))

    def measure(state: Column, x: Column) -> Column:
        here = F.struct((state["at"] + F.length(x["t"]["head"])).alias("start"), F.length(x["t"]["body"]).alias("length"))
        new = (x["i"] >= F.size("context")) & x["t"]["target"]
        return F.struct(
            (state["at"] + F.length(shown(x["t"]))).alias("at"),
            F.when(new, F.concat(state["found"], F.array(here))).otherwise(state["found"]).alias("found"),
        )

    numbered = F.transform("whole", lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return spans.select(
        "conv_id",
        F.row_number().over(in_order).alias("window"),
        F.size("context").alias("n_context"),
        F.size("turns").alias("n_turns"),
        (F.col("used") + F.col("back")["n"]).alias("tokens"),
        (F.col("used") > budget).alias("over_budget"),
        F.array_join(F.transform("whole", shown), "").alias("formatted"),
        F.aggregate(numbered, lengths, measure, lambda s: s["found"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of ``role, text``."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TEXT, 1)
        return F.struct(
            F.url_decode(F.substring(head, F.lit(len(TURN) + 1), F.length(head))).alias("role"),
            unescaped(F.substring(piece, F.length(head) + (len(TEXT) + 1), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def own_turns(windowed: DataFrame) -> Column:
    """New turns of each window, read back from the output; the system turn counts in the first window."""
    turns = read_back(F.col("formatted"))
    first = F.when((F.col("window") == 1), 0).otherwise(F.col("n_context"))
    return F.slice(turns, first + 1, F.col("n_context") + F.col("n_turns") - first)


def target_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"]))), "")


def digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Per conversation: what the windows say, read back from their text and masks."""
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, TARGET, probe)], "conv_id long, turn long, role string, text string")
    found = windows(conversations.select("conv_id", "turn", "role", "text").unionByName(more))
    parts = found.select(
        "conv_id",
        F.struct(
            "window",
            own_turns(found).alias("turns"),
            target_text(F.col("formatted"), F.col("loss")).alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns = F.flatten(F.col("w.turns"))
    line = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.encode(line, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.aggregate(F.col("w.chars"), F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )

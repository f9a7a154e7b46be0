r"""Operator 4: budgeted chat windows (native).

Turns are written as ``<|im_start|>role\n text <|im_end|>\n``. Prefix sums of
the turns' tokens choose turn-aligned spans: a stride is half of what the
budget leaves beside the system turn and the repeated history, a turn belongs
to the stride its last token falls in, and a turn longer than a stride stands
alone. So a window holds at most ``budget`` tokens unless a single turn is
longer. Every later window repeats the system turn (the first turn, if its role
is ``system``) and the turns before the span that fit ``history`` tokens; what
is repeated is outside the loss mask, so each assistant text is a target once.

Inside texts and roles the first character of every control string is escaped
(``\l`` for ``<``, ``\b`` for ``[``, ``\s`` for the escape character, and
``\e`` for a line end in a role), which ``read_turns`` and ``unescape`` undo.

Cases: null texts and roles are empty; turns are ordered by (turn, role, text)
with nulls first, so repeated and tied turns have one order and are all kept; a
null conv_id is a conversation of its own; an empty table gives an empty
result; other columns are ignored. A conversation's turns meet in one row, as
the digest of a conversation needs them to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL_ANGLE = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)"
CONTROL_SQUARE = r"\[(?=/?INST\])"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    c = F.regexp_replace(c, CONTROL_ANGLE, r"\\l")
    return F.regexp_replace(c, CONTROL_SQUARE, r"\\b")


def unescape(c: Column) -> Column:
    for code, char in (("\\l", "<"), ("\\b", "["), ("\\e", "\n"), ("\\s", "\\")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def turn_tokens(text: Column) -> Column:
    """A cheap native measure: a token for each four bytes, and four for the marks."""
    return (F.octet_length(text) / 4).cast("long") + 5


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 192) -> DataFrame:
    """conv_id, window, repeated (leading turns outside the loss), formatted,
    loss (array of <start, length> in characters of ``formatted``)."""
    clean = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = clean.withColumns({"no": F.row_number().over(order).cast("long"), "tokens": turn_tokens(F.col("text")),
                           "body": escape(F.col("text")),
                           "mark": F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\e"))}).drop("text")
    by_no = Window.partitionBy("conv_id").orderBy("no")
    run = by_no.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("is_system", (F.col("no") == 1) & (F.col("role") == "system"))
    t = t.withColumn("system", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(run))
    stride = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("system") - history) / 2))
    cost = F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))
    t = t.withColumns({"stride": stride, "cost": cost})
    long_turn = F.col("cost") > F.col("stride")
    cut = long_turn | F.coalesce(F.lag(long_turn).over(by_no), F.lit(False))
    t = t.withColumns({"cum": F.sum("cost").over(run), "cut": cut.cast("long")})
    t = t.withColumn("segment", F.sum("cut").over(run))
    in_segment = Window.partitionBy("conv_id", "segment").orderBy("no").rowsBetween(Window.unboundedPreceding,
                                                                                     Window.currentRow)
    t = t.withColumn("span", F.when(long_turn, 0).otherwise(
        F.floor((F.greatest(F.lit(1), F.sum("cost").over(in_segment)) - 1) / F.col("stride"))))
    # the earliest turn that still fits the history before a turn: a range of the prefix sums
    t = t.withColumn("before", F.col("cum") - F.col("cost"))
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    t = t.withColumn("reach", F.min(F.when(~F.col("is_system"), F.col("no"))).over(near))
    spans = t.where("not is_system or no = 1").groupBy("conv_id", "segment", "span").agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.min_by("reach", "no").alias("reach"))
    spans = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "reach")))
                                         .alias("spans"))
    convs = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("no", "mark", "body", "role", "is_system"))).alias("turns"))
    each = convs.join(spans, convs["conv_id"].eqNullSafe(spans["conv_id"])).select(
        convs["conv_id"], "turns", F.posexplode("spans").alias("window", "s"))
    system = F.filter(F.slice("turns", 1, 1), lambda x: x["is_system"])
    reach = F.least(F.coalesce(F.col("s.reach"), F.col("s.first")), F.col("s.first"))
    old = F.when(F.col("window") == 0, F.slice("turns", 1, 0)).otherwise(F.concat(
        system, F.slice("turns", reach.cast("int"), (F.col("s.first") - reach).cast("int"))))
    new = F.slice("turns", F.col("s.first").cast("int"), (F.col("s.last") - F.col("s.first") + 1).cast("int"))
    each = each.select("conv_id", "window", F.size(old).alias("repeated"), F.concat(old, new).alias("turns"))
    pieces = F.transform("turns", lambda x: F.concat(F.lit(START), x["mark"], F.lit("\n"), x["body"],
                                                     F.lit(END + "\n")))
    each = each.withColumn("pieces", pieces)
    # where each turn's text starts: prefix sums of the pieces' lengths
    ends = F.aggregate("pieces", F.array(F.lit(0)),
                       lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x))))
    each = each.withColumn("starts", ends)
    marked = F.transform("turns", lambda x, i: F.struct(
        (F.get("starts", i) + F.char_length(x["mark"]) + len(START) + 1).alias("start"),
        F.char_length(x["body"]).alias("length"), ((x["role"] == "assistant") & (i >= F.col("repeated"))).alias("on")))
    loss = F.transform(F.filter(marked, lambda x: x["on"]), lambda x: F.struct(x["start"], x["length"]))
    return each.select("conv_id", "window", "repeated", F.array_join("pieces", "").alias("formatted"),
                       loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<role, text> read back from one formatted window."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring_index(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2), END, 1))
        .alias("text")))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars:
    everything from ``format_windows``' output alone."""
    own = F.slice(read_turns(F.col("formatted")), F.col("repeated") + 1, 1 << 30)
    said = F.transform(own, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    parts = windows.select("conv_id", "window", F.size(own).alias("n"), F.array_join(said, "").alias("said"),
                           F.array_join(loss, "").alias("loss"), F.char_length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"))
    said_all = F.array_join(F.transform("w", lambda x: x["said"]), "")
    loss_all = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said_all, 256).alias("turns_sha256"),
                        F.char_length(loss_all).cast("long").alias("loss_chars"),
                        F.sha2(loss_all, 256).alias("loss_sha256"), "formatted_chars")

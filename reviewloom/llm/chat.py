"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes one or more training texts. Prefix sums of the turns' sizes deal
the turns to windows, whole turns each: the sums are cut at equal distances, turns between
two cuts are a window, and a turn across a cut is one by itself. Every window begins with the system turn of the
conversation and a limited number of turns that were in the window before; only what a
window has first is under its loss mask, so that each answer is a target once.

Sizes are counted in quarters of formatted characters, rounded up, the usual stand-in
for tokens where no tokenizer runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared

# Template: fixed strings. Escaped text has neither "#" nor "<", so none of them occurs in it.
HEAD, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
#: Window size, and the part of it that may repeat earlier turns.
BUDGET, HISTORY = 512, 128
#: Turn numbers that are summed as one block, so that no long conversation is one task.
BLOCK = 256


def escape(text: Column) -> Column:
    """Backslash, "#" and "<" as two characters each."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    """The same, and the colon that would end a role."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    """Undo both: a doubled backslash is taken out first, left to right."""
    one = lambda x, code, mark: F.replace(x, F.lit(code), F.lit(mark))
    part = lambda x: one(one(one(x, "\\h", "#"), "\\l", "<"), "\\c", ":")
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def windows(df: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows (conv_id, window, formatted, loss, repeated) from (conv_id, turn, role, text).

    ``loss`` has (start, length) of the targets in characters of ``formatted``;
    ``repeated`` is the number of turns at its start that an earlier window has too.
    Null role or text is empty. Turns of one number go by role, then text; null numbers
    come first; repeated rows are turns of their own; a null ``conv_id`` is a
    conversation. No window exceeds the budget but for one whose only new turn does not fit
    in it beside the system turn.
    Without rows there are no windows. Other columns are left out.
    """
    prepared(df.sparkSession)
    rows = df.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escape_role(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    )
    rows = rows.withColumn("block", F.expr(f"floor(turn / {BLOCK})")).withColumn(
        "head", F.concat(F.lit(HEAD), "role", F.lit(AFTER_ROLE))
    )
    rows = rows.withColumn("made", F.concat("head", "text", F.lit(END)))
    rows = rows.withColumn("size", F.ceil(F.length("made") / 4).cast("long"))

    # prefix sums: totals of blocks first, then within each block
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    totals = rows.groupBy("conv_id", "block").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min(F.struct("turn", "role", "made", "size")).alias("least")
    )
    # the least struct is the first turn: fields go in the order of the turns
    blocks = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    past = blocks.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "conv_id",
        "block",
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("total").over(past), F.lit(0)).alias("size_before"),
        F.first("least").over(blocks.rowsBetween(Window.unboundedPreceding, 0)).alias("opening"),
    )
    a, b = rows.alias("a"), totals.alias("b")
    met = a.join(b, a["conv_id"].eqNullSafe(b["conv_id"]) & a["block"].eqNullSafe(b["block"])).select(
        "a.*", "b.n_before", "b.size_before", "b.opening"
    )
    within = Window.partitionBy("conv_id", "block").orderBy(*order)
    system = F.col("opening.role") == "system"
    is_system = system & (F.col("at") == 0)
    met = met.withColumn("at", F.col("n_before") + F.row_number().over(within) - 1)
    met = met.withColumn(
        "sum", F.col("size_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    met = met.withColumn("kept", F.when(system, F.col("opening.size")).otherwise(F.lit(0)))
    met = met.withColumn("sum", F.greatest(F.lit(0), F.col("sum") - F.col("kept")))
    left = F.lit(budget) - F.col("kept")
    met = met.withColumn("stride", F.greatest(left - history, F.floor(left / 2), F.lit(1)).cast("long"))
    # window 2j has what lies between two cuts, window 2j + 1 what crosses the second one
    met = met.withColumn("own", F.when(is_system, F.lit(0)).otherwise(F.col("size")))
    met = met.withColumn("span", F.expr("2 * (sum div stride) + if(sum % stride + own > stride, 1, 0)"))

    # a turn is new in its own window and may be repeated in the next two, one of which
    # may not be there
    member = lambda window, new: F.struct(
        window.alias("window"), F.lit(new).alias("new")
    )
    both = F.array(*[member(F.col("span") + i, i == 0) for i in range(3)])
    dealt = met.withColumn("m", F.explode(F.when(is_system, F.slice(both, 1, 1)).otherwise(both)))
    turn = F.struct("at", "sum", "size", F.col("m.new").alias("new"), (F.col("role") == "assistant").alias("target"), "head", "made")
    grouped = dealt.groupBy("conv_id", F.col("m.window").alias("window")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        F.max("kept").alias("kept"),
        F.min(F.when(F.col("m.new"), F.col("sum"))).alias("start"),
        F.sum(F.when(F.col("m.new"), F.col("size"))).alias("fresh"),
        F.max(F.when(system, F.struct("opening.made", F.length("opening.made").alias("n")))).alias("opening"),
        F.min("at").alias("first_at"),
    )
    grouped = grouped.where("start is not null").withColumn(
        "room", F.expr(f"least({history}, {budget} - kept - fresh)")
    )
    grouped = grouped.withColumn("turns", F.expr("filter(turns, t -> t.new or start - t.sum <= room)"))
    # the system turn is repeated in every window but the one it is new in
    again = F.expr("opening is not null and not exists(turns, t -> t.new and t.at = 0)")
    prefix = F.when(again, F.col("opening.made")).otherwise(F.lit(""))
    grouped = grouped.withColumn("prefix", prefix)
    formatted = F.concat("prefix", F.array_join(F.expr("transform(turns, t -> t.made)"), ""))
    walked = F.expr(
        f"""aggregate(turns,
          named_struct('at', length(prefix), 'spans', cast(array() as array<struct<start:int,length:int>>)),
          (s, t) -> named_struct('at', s.at + length(t.made), 'spans',
            if(t.new and t.target,
               concat(s.spans, array(named_struct('start', s.at + length(t.head),
                                                  'length', length(t.made) - length(t.head) - {len(END)}))),
               s.spans)))"""
    )
    return grouped.select(
        "conv_id",
        "window",
        formatted.alias("formatted"),
        walked.getField("spans").alias("loss"),
        (F.expr("size(filter(turns, t -> not t.new))") + F.when(again, 1).otherwise(0)).alias("repeated"),
    )


def turns_of(formatted: DataFrame) -> DataFrame:
    """Read windows back: adds ``new_turns`` (role, text) and ``targets``, the texts under the mask."""
    parts = F.expr(f"slice(split(formatted, '{END[:-1]}\\n'), repeated + 1, size(split(formatted, '{END[:-1]}\\n')))")
    whole = F.filter(parts, lambda x: x != "")
    head = len(HEAD)
    pair = lambda x: F.struct(
        unescape(x.substr(F.lit(head + 1), F.instr(x, AFTER_ROLE) - head - 1)).alias("role"),
        unescape(x.substr(F.instr(x, AFTER_ROLE) + len(AFTER_ROLE), F.length(x))).alias("text"),
    )
    cut = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("new_turns", F.transform(whole, pair)).withColumn("targets", cut)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows.

    A digest is of all of a conversation's text, so that text meets in one task; rows
    with the same ``conv_id`` are one conversation by definition.
    """
    said = F.array_join(
        F.transform("new_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    each = turns_of(formatted).select(
        "conv_id",
        F.struct("window", said.alias("said"), F.array_join("targets", "").alias("target")).alias("w"),
        F.size("new_turns").alias("n"),
        F.length("formatted").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("w", lambda w: w["said"]), "")
    target = F.array_join(F.transform("w", lambda w: w["target"]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

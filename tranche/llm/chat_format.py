"""Chat formatting in budgeted windows.

A conversation's turns are laid along a line by the prefix sums of their token
costs, and the line is ruled at multiples of the span budget.  Turns within one
cell make a window; a turn across a rule is a window of its own.  So a window's
own turns never exceed the span budget, unless a single turn does.  Every window
but the first begins with context: the first system turn so far, and up to
``history`` of the turns just before it within the history budget.  Context is
not trained on: the loss mask covers the texts of a window's own assistant turns,
hence each once over the conversation.

A turn is written as start mark, role, separator, text, end mark.  Marks, and the
other control strings, are broken within roles and texts by a backslash after
their first character; backslashes are doubled, so ``unescape`` restores them.

DataFrame functions only.  A window's rows are bounded by the budget; the prefix
sums stream through one sorted partition per conversation and hold no rows.

Defined cases: null texts and roles are empty; turns are ordered by turn (null
first), then role and text, so repeated rows are repeated turns; null conv_ids
are one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# Marks of the template, and control strings of public chat templates.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEPARATOR, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Settings:
    span: int = 1536              # tokens of a window's own turns
    history_span: int = 384       # tokens of repeated turns
    history: int = 2              # repeated turns
    bytes_a_token: int = 4        # how tokens are counted: bytes / this, rounded up, and the marks
    mark_tokens: int = 4
    trained: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def written(role: Column, text: Column) -> Column:
    """A turn as it stands in the output (role and text escaped)."""
    return F.concat(F.lit(START), role, F.lit(SEPARATOR), text, F.lit(END))


def windows(turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per window: conv_id, window, n_context, text, loss (array of start and length, in characters)."""
    rows = turns.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"),
                        escape(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumn("cost", (F.ceil(F.octet_length("body") / s.bytes_a_token) + s.mark_tokens).cast("long"))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (rows.withColumn("at", F.row_number().over(line))
            .withColumn("start", F.coalesce(F.sum("cost").over(before), F.lit(0)))
            .withColumn("cell", F.floor(F.col("start") / s.span))
            .withColumn("across", F.col("cell") != F.floor((F.col("start") + F.col("cost") - 1) / s.span)))
    turn = F.struct("at", "role", "body", "cost")
    first_system = F.first(F.when(F.col("role") == "system", turn), ignorenulls=True).over(before)
    rows = rows.withColumn("system", first_system)
    for k in range(1, s.history + 1):
        rows = rows.withColumn(f"past{k}", F.lag(turn, k).over(line))
    new = F.coalesce((F.lag("cell").over(line) != F.col("cell")) | (F.lag("across").over(line) != F.col("across")), F.lit(True))
    rows = rows.withColumn("begins", new | F.col("across"))
    rows = rows.withColumn("window", F.sum(F.col("begins").cast("int")).over(so_far))

    # Context of a window's first turn: the system turn, then the nearest past turns that fit, oldest first.
    kept, spent = [], F.lit(0).cast("long")
    for k in range(1, s.history + 1):
        past = F.col(f"past{k}")
        spent = spent + F.coalesce(past["cost"], F.lit(s.history_span + 1))
        kept.append(F.when((spent <= s.history_span) & ~past["at"].eqNullSafe(F.col("system")["at"]), past))
    context = F.filter(F.array(F.col("system"), *reversed(kept)), lambda t: t.isNotNull())
    shown = F.transform(context, lambda t: written(t["role"], t["body"]))
    rows = rows.select("conv_id", "window", "at", "role", "body", F.when(F.col("begins"), shown).alias("context"))

    # Places of the pieces within the window's own part.
    rows = rows.withColumn("piece", written(F.col("role"), F.col("body")))
    within = Window.partitionBy("conv_id", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.coalesce(F.sum(F.length("piece")).over(within), F.lit(0)))
    masked = F.when(F.col("role").isin(*s.trained), F.struct(
        (F.col("place") + len(START) + F.length("role") + len(SEPARATOR)).alias("start"), F.length("body").cast("long").alias("length")))
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", masked.alias("loss")))).alias("own"),
        F.flatten(F.collect_list("context")).alias("context"))
    head = F.array_join("context", "")
    spans = F.filter(F.transform("own", lambda t: t["loss"]), lambda m: m.isNotNull())
    return grouped.select(
        "conv_id", "window", F.size("context").alias("n_context"),
        F.concat(head, F.array_join(F.transform("own", lambda t: t["piece"]), "")).alias("text"),
        F.transform(spans, lambda m: F.struct((m["start"] + F.length(head)).alias("start"), m["length"].alias("length"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, trained, n_chars): own turns (array of role and text) and trained texts, read from the output."""
    formatted = formatted.withColumn("pieces", F.split("text", r"\Q" + START + r"\E"))
    pieces = F.slice("pieces", F.col("n_context") + 2, F.size("pieces"))     # nothing stands before the first mark
    end = len(SEPARATOR)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, SEPARATOR, 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, F.lit(SEPARATOR)) + end,
                          F.length(p) - F.instr(p, F.lit(SEPARATOR)) - (end - 1) - len(END))).alias("text"))
    return formatted.select(
        "conv_id", "window", F.transform(pieces, turn).alias("turns"),
        F.transform("loss", lambda m: unescape(F.substr(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("trained"),
        F.length("text").cast("long").alias("n_chars"))


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: counts and SHA-256 of its turns and of the text under the loss mask."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = (read.select("conv_id", "window", F.size("turns").alias("n"), told.alias("told"), F.array_join("trained", "").alias("trained"), "n_chars")
             .groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"),
                                     F.sort_array(F.collect_list(F.struct("window", "told", "trained"))).alias("all")))
    joined = lambda c: F.array_join(F.transform("all", lambda w: w[c]), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return whole.select("conv_id", "n_turns", sha(joined("told")).alias("turns_sha256"),
                        F.length(joined("trained")).cast("long").alias("loss_chars"), sha(joined("trained")).alias("loss_sha256"),
                        F.col("formatted_chars").cast("long"))

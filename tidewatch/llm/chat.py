"""Chat formatting in budgeted windows.

A conversation's turns are counted in tokens (words and a few for the marks). Prefix
sums place each turn: window ``k`` takes the turns whose sum before them lies in
``[k * budget, (k + 1) * budget)``, whole turns only. A window opens with the
conversation's first system turn, repeats the last turns of the window before as far
as ``history`` tokens go, and then has its own turns. Only its own assistant turns
are under the loss mask, so that each is a target exactly once.

A turn is written ``### role: text </turn>`` and a line feed. Inside texts, ``\\``,
``#`` and ``<`` are escaped with a backslash (in roles also ``:``), so no text can
hold a mark, and :func:`read_back` gives the turns again.

Null texts and roles are empty. Turns go by number, null first, ties by role and text;
repeated rows are turns of their own. A null conversation id is a conversation. One
turn longer than the budget stays whole. Prefix sums go over blocks of turn numbers
first, so a very long conversation is spread; a window is the most that meets in one
place. No rows, no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES

#: Tokens of a window's own turns and of its repeated history; tokens for the marks of a turn.
BUDGET, HISTORY, MARKS = 512, 128, 4
#: Turn numbers of one block of the prefix sums.
BLOCK = 256
SYSTEM, TARGET = "system", "assistant"
HEAD, MIDDLE, END = "### ", ": ", " </turn>\n"


def _escaped(column: str, marks: str):
    return F.regexp_replace(F.col(column), f"([{marks}])", r"\\$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, window, formatted, spans)``; a span is a turn in code points of ``formatted``.

    ``start`` and ``length`` are the whole turn's, ``text_start`` and ``text_length`` those of its
    escaped text without the marks; ``own`` says whether it is the window's own turn, ``loss``
    whether that text is under the loss mask (the marks never are).
    """
    if history > budget:
        raise ValueError("the history may not exceed the budget")
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce(F.floor(F.col("t") / BLOCK), F.lit(-(1 << 40))).alias("b"),
                       (F.size(F.array_remove(F.split("text", f"[{SPACES}]+"), "")) + MARKS).cast("long").alias("tokens"))
    order = W.partitionBy("c", "b").orderBy(F.col("t").asc_nulls_first(), "role", "text")
    rows = rows.select("*", F.row_number().over(order).alias("i"), F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("inside"))
    blocks = rows.groupBy("c", "b").agg(F.sum("tokens").alias("s")).select(
        F.col("c").alias("bc"), F.col("b").alias("bb"),
        F.coalesce(F.sum("s").over(W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("b") == F.col("bb"))).select(
        "c", "b", "i", "role", "tokens", (F.col("base") + F.coalesce("inside", F.lit(0))).alias("before"),
        F.concat(F.lit(HEAD), _escaped("role", r"\\#<:"), F.lit(MIDDLE), _escaped("text", r"\\#<"), F.lit(END)).alias("piece"),
        F.length(_escaped("text", r"\\#<")).alias("body"))
    rows = rows.withColumn("k", F.floor(F.col("before") / budget))
    rows = rows.withColumn("stop", F.max(F.col("before") + F.col("tokens")).over(W.partitionBy("c", "k")))
    spans = rows.groupBy("c", "k").agg(F.min(F.when(F.col("role") == SYSTEM, F.struct("b", "i", "piece", "body"))).alias("s")).select(
        "c", "k", F.lead("k").over(W.partitionBy("c").orderBy("k")).alias("next"),
        F.min("s").over(W.partitionBy("c")).alias("system"), F.first("k").over(W.partitionBy("c").orderBy(F.col("s").asc_nulls_last())).alias("home"))
    keys = spans.select(F.col("c").alias("sc"), F.col("k").alias("sk"), "next")
    own = rows.select("c", "k", F.lit(2).alias("part"), "b", "i", "piece", "body", F.lit(True).alias("own"), (F.col("role") == TARGET).alias("loss"))
    kept = (rows.where(F.col("stop") - F.col("before") <= history)
            .join(keys, F.col("c").eqNullSafe(F.col("sc")) & (F.col("k") == F.col("sk")) & F.col("next").isNotNull())
            .select("c", F.col("next").alias("k"), F.lit(1).alias("part"), "b", "i", "piece", "body", F.lit(False).alias("own"), F.lit(False).alias("loss")))
    system = spans.where("system IS NOT NULL AND k <> home").select(
        "c", "k", F.lit(0).alias("part"), F.col("system.b").alias("b"), F.col("system.i").alias("i"), F.col("system.piece").alias("piece"),
        F.col("system.body").alias("body"), F.lit(False).alias("own"), F.lit(False).alias("loss"))
    pieces = own.unionAll(kept).unionAll(system)
    grouped = pieces.groupBy("c", "k").agg(F.sort_array(F.collect_list(F.struct("part", "b", "i", "piece", "body", "own", "loss"))).alias("p"))
    return grouped.select(
        F.col("c").alias(conv_col), F.col("k").alias("window"), F.expr("array_join(transform(p, x -> x.piece), '')").alias("formatted"),
        F.expr("""aggregate(p, struct(0 AS at, cast(array() AS array<struct<start: int, length: int, text_start: int, text_length: int, own: boolean, loss: boolean>>) AS spans),
                  (a, x) -> struct(a.at + length(x.piece) AS at,
                                   concat(a.spans, array(struct(a.at AS start, length(x.piece) AS length, a.at + length(x.piece) - %d - x.body AS text_start,
                                                              x.body AS text_length, x.own AS own, x.loss AS loss))) AS spans),
                  a -> a.spans)""" % len(END)).alias("spans"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(conv, window, place, role, text, loss)``: the turns of each window's own, parsed by their marks and unescaped.

    The end mark parts the turns, and a role ends at the first ``: `` that is not escaped;
    of the spans only the flags are used.
    """
    pieces = F.split("formatted", END, -1)
    turns = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("piece"), F.col("spans").alias("s"))
    rows = formatted.select(F.col(conv_col), "window", F.posexplode_outer(turns).alias("place", "turn")).where("turn.s.own")
    rows = rows.select(conv_col, "window", "place", F.col("turn.piece").alias("piece"), F.col("turn.s.loss").alias("loss"))
    rows = rows.withColumn("head", F.regexp_extract("piece", r"^### ((?:[^\\:]+|\\.)*+): ", 1))
    body = F.expr(f"substring(piece, length(head) + {len(HEAD) + len(MIDDLE) + 1})")
    plain = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    return rows.select(conv_col, "window", "place", plain(F.col("head")).alias("role"), plain(body).alias("text"), "loss")


def loss_texts(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``(conv, window, place, text)``: what lies under the loss mask, unescaped."""
    rows = formatted.select(F.col(conv_col), "window", "formatted", F.posexplode_outer("spans").alias("place", "s")).where("s.loss")
    return rows.select(conv_col, "window", "place", F.regexp_replace(F.expr("substring(formatted, s.text_start + 1, s.text_length)"), r"(?s)\\(.)", "$1").alias("text"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of what its windows hold, read back from them."""
    turns = read_back(formatted, conv_col).groupBy(conv_col).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "place", "role", "text", "loss"))).alias("p"))
    targets = F.expr("array_join(transform(filter(p, x -> x.loss), x -> x.text), '')")
    turns = turns.select(conv_col, "n_turns",
                         F.sha2(F.expr("array_join(transform(p, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
                         F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"))
    sizes = formatted.groupBy(F.col(conv_col).alias("__conv")).agg(F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    return turns.join(sizes, F.col(conv_col).eqNullSafe(F.col("__conv"))).drop("__conv")

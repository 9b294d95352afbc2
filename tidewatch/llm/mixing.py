"""Mixing sources to target weights by Poisson replication.

Every named source, and the rest together, has a target share of the mixture's text.
Its repetition rate is ``share * all characters / its characters``. A number seeded by
the id's hash, uniform in [0, 1), is inverted through the Poisson distribution of that
rate: so many copies of the document come out (none, one or several), each with a key
by which the mixture is dealt over all partitions and ordered inside them.

A null or unlisted source belongs to the rest. Null texts have no characters. Sources
without characters, or of share 0, come out 0 times; a rate over ``MOST_RATE`` is an error. Rows of equal ids get equal
counts; a null id counts as the text "null". Columns named ``copy`` and
``shuffle_key`` are replaced; no rows, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import parts

#: Production shares; what is left of 1 goes to the rest.
WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.04}
SEED = "mix-1"
#: Named sources, hence rows of the broadcast rates, at most.
MOST_SOURCES = 1000
#: A source that would be repeated more often is refused: it cannot have its share.
MOST_RATE = 1e8
#: Copies numbered in one array.
RUN = 4096


def fraction(*parts_of_key: Column) -> Column:
    """A number in [0, 1) of 52 hash bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts_of_key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, group: str, size: str, weights: dict[str, float]) -> DataFrame:
    """Repetition rate of each group, and the Poisson probabilities of at most ``first``, ``first + 1``, .. copies (``below``).

    ``len(weights) + 1`` rows at most. A table spans the counts that have any probability in
    52 bits, about 52 times the root of the rate, and its sums run over rows, not over a
    growing array; ``MOST_RATE`` bounds it.
    """
    sizes = docs.groupBy(group).agg(F.sum(size).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("t")).scalar()
    share = F.lit(max(0.0, 1.0 - sum(weights.values())))
    for name, weight in weights.items():
        share = F.when(F.col(group) == name, F.lit(float(weight))).otherwise(share)
    rate = F.when(F.col("_size") > 0, share * total / F.col("_size")).otherwise(F.lit(0.0))
    told = F.concat(F.lit("repetition rate of source "), F.col(group), F.lit(f" is over {MOST_RATE}: "), F.col("rate").cast("string"))
    rate_rows = sizes.select(group, rate.alias("rate"))
    rate_rows = rate_rows.withColumn("rate", F.when(F.col("rate") > MOST_RATE, F.raise_error(told).cast("double")).otherwise(F.col("rate")))
    span = rate_rows.where("rate > 0").selectExpr(
        f"`{group}`", "rate", "cast(greatest(0, ceil(rate - 40 * sqrt(rate) - 40)) AS bigint) AS first", "cast(ceil(rate + 12 * sqrt(rate) + 40) AS bigint) AS last")
    # log probability of the first count: by Stirling's series where it is not 0 (then it is in the hundreds)
    start = F.expr("""CASE WHEN first = 0 THEN -rate ELSE first * ln(rate) - rate
        - ((first + 0.5D) * ln(first + 0D) - first + 0.5D * ln(2 * pi()) + 1 / (12D * first) - 1 / (360D * first * first * first)) END""")
    counts = span.withColumn("start", start).withColumn("k", F.explode(F.sequence("first", "last")))
    order = Window.partitionBy(group).orderBy("k")
    logs = counts.withColumn("t", F.sum(F.when(F.col("k") == F.col("first"), F.col("start")).otherwise(F.log(F.col("rate") / F.col("k")))).over(order))
    sums = logs.withColumn("c", F.sum(F.exp("t")).over(order))
    below = sums.groupBy(group).agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("below"))
    return rate_rows.join(below.select(group, "first", F.col("below.c").alias("below")), group, "left")


#: How many of ``below`` (ascending) are at most u: a look at each of a few, else a binary search.
COUNT = """CASE WHEN size({below}) <= 64 THEN size(filter({below}, p -> p <= {u})) ELSE
    aggregate(sequence(1, 32), named_struct('a', 0, 'b', size({below})), (s, i) -> CASE WHEN s.a >= s.b THEN s
        WHEN element_at({below}, cast(floor((s.a + s.b) / 2) AS int) + 1) <= {u} THEN named_struct('a', cast(floor((s.a + s.b) / 2) AS int) + 1, 'b', s.b)
        ELSE named_struct('a', s.a, 'b', cast(floor((s.a + s.b) / 2) AS int)) END, s -> s.a) END"""


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with ``copy`` (from 1) and ``shuffle_key``, a row for each copy, in the order of a global shuffle."""
    weights = WEIGHTS if weights is None else weights
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} named sources")
    group = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit("\u0000rest"))
    columns = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    sized = docs.select(group.alias("_group"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_chars"))
    rate = rates(sized, "_group", "_chars", weights).withColumnsRenamed(
        {"_group": "__mix_group", "rate": "__mix_rate", "first": "__mix_first", "below": "__mix_below"})
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # the rates have a row for each named source and the rest: bounded by MOST_SOURCES + 1
    rows = docs.withColumn("__mix_at", group).join(F.broadcast(rate), F.col("__mix_at") == F.col("__mix_group"))
    rows = rows.withColumn("__mix_u", fraction(key, F.lit(seed)))
    rows = rows.withColumn("__mix_n", F.coalesce(F.col("__mix_first") + F.expr(COUNT.format(below="__mix_below", u="__mix_u")), F.lit(0)))
    # copies in runs, so that no row holds the numbers of all
    rows = rows.where("__mix_n > 0 AND __mix_rate > 0").withColumn("__mix_run", F.explode_outer(F.expr(f"sequence(0L, (__mix_n - 1) div {RUN})")))
    rows = rows.withColumn("copy", F.explode_outer(F.expr(f"sequence(cast(__mix_run * {RUN} + 1 AS int), cast(least(__mix_n, (__mix_run + 1) * {RUN}) AS int))")))
    rows = rows.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(":", key, F.col("copy").cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long"))
    return rows.select(*columns, "copy", "shuffle_key").repartition(parts(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")

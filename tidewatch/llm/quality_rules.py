"""Quality rules with risk-controlled thresholds.

Whole-text figures are in-row expressions. A rule rejects texts whose figure, in
thousandths of their words, is over a cutoff. For each stratum, rule and cutoff of a
fixed grid, the labelled good texts that it would reject are counted, and an exact
binomial test asks whether the true share of false rejections could be ``risk`` or
more. A cutoff is certified when that has a probability of at most
``error / number of tests`` (Bonferroni over all strata, rules and cutoffs); ``risk``
is the budget of all rules divided by their number. Of the certified cutoffs of a
stratum and rule, the one with the largest surplus of bad over good rejections
counts, the loosest among ties; without one, the rule is off there.

Null texts have no words. Null or unlisted strata are one stratum, "other". Repeated
rows and labels count as often as they occur; null labels are left out; without any
labels only the base rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACES, staged

#: Figures in thousandths of the words, each with its grid of cutoffs.
GRID = (0, 20, 50, 100, 150, 200, 300, 500)
RULES = ("n_symbols", "n_dup_lines", "n_repeat_words")
STRATA = ("en", "de", "es", "fr")
#: False rejections allowed for all rules together, and the chance that any certified cutoff breaks it.
RISK, ERROR = 0.03, 0.1
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the figures of :data:`FIGURES` and ``base_failed``; the helper columns start with ``_``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_t", text)
    out = out.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACES}]+"), ""))
    out = out.withColumn("_n", F.size("_w"))
    # hashes of the 3-word windows, and those found twice or more with their places
    out = out.withColumn("_h", F.expr(
        "CASE WHEN _n >= 4 THEN transform(sequence(0, _n - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END"))
    out = out.withColumn("_s", F.expr(
        "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) END"))
    out = out.withColumn("_d", F.expr(
        "filter(_s, (x, i) -> coalesce(get(_s, i - 1).h = x.h, false) OR coalesce(get(_s, i + 1).h = x.h, false))"))
    lines = "filter(split(_t, '\\n'), l -> btrim(l, ' \\t\\n\\u000b\\f\\r') <> '')"
    out = out.withColumn("_l", F.expr(lines))
    return out.select(
        "*",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.expr("size(array_distinct(flatten(transform(_d, x -> array(x.i, x.i + 1, x.i + 2)))))"), F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("_t", "_w", "_n", "_h", "_s", "_d", "_l").withColumn(
        "base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def over(rule: str, cutoff: Column | int) -> Column:
    """Whether the figure is over so many thousandths of the words."""
    return 1000 * F.col(rule) > F.col("n_words") * cutoff


def stratum(column: Column, strata: tuple[str, ...]) -> Column:
    return F.when(column.isin(*strata), column).otherwise(F.lit("other"))


def log_binomial_at_most(n: str, k: str, p: float) -> str:
    """SQL for the logarithm of P(X <= k) with X binomial (n, p), summed term by term."""
    first = f"{n} * ln(1 - {p}D)"
    step = f"a.t + ln(({n} - i + 1) / i) + ln({p}D / (1 - {p}D))"
    return (f"CASE WHEN {k} = 0 THEN {first} ELSE aggregate(sequence(1, {k}), struct({first} AS t, {first} AS s), "
            f"(a, i) -> struct({step} AS t, greatest(a.s, {step}) + log1p(exp(-abs(a.s - ({step})))) AS s), a -> a.s) END")


def cutoffs(labelled: DataFrame, strata_col: str, good_col: str, strata: tuple[str, ...] = STRATA,
            grid: tuple[int, ...] = GRID, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum with the certified cutoff of each rule (null: off).

    ``labelled`` has the figures and a label (1 good, 0 bad); texts that fail the base rules are left out.
    At most ``len(strata) + 1`` rows.
    """
    each = risk / len(RULES)
    level = error / ((len(strata) + 1) * len(RULES) * len(grid))
    rows = labelled.where(F.col(good_col).isNotNull() & ~F.col("base_failed")).withColumn("_stratum", stratum(F.col(strata_col), strata))
    good = F.col(good_col) == 1
    counts = rows.groupBy("_stratum").agg(F.count_if(good).alias("_good"), *[
        F.count_if(over(r, c) & flag).alias(f"{r}_{c}_{name}") for r in RULES for c in grid for flag, name in ((good, "k"), (~good, "b"))])
    tests = counts.select("_stratum", "_good", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}_k").alias("k"), F.col(f"{r}_{c}_b").alias("b"))
        for r in RULES for c in grid])).alias("e")).select("_stratum", "_good", "e.*")
    certified = tests.where(F.expr(f"k < _good * {each}D AND {log_binomial_at_most('_good', 'k', each)} <= ln({level}D)"))
    best = certified.groupBy("_stratum", "rule").agg(F.max(F.struct((F.col("b") - F.col("k")).alias("gain"), "cutoff")).alias("m"))
    return best.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("m.cutoff"))).alias(f"_{r}") for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata_col: str = "lang",
          good_col: str = "quality", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """``(id, figures, base_failed, kept)`` for each row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(strata_col).alias("_lang"))
    figures = staged(with_figures(slim, "_text").drop("_text"), "figures")
    known = labels.select(F.col(id_col).alias("_id"), F.col(good_col).alias("_label"))
    chosen = cutoffs(figures.join(known, "_id"), "_lang", "_label", strata)
    # one row for each of the listed strata and "other" at most
    rows = figures.withColumn("_stratum", stratum(F.col("_lang"), strata)).join(F.broadcast(chosen), "_stratum", "left")
    rejected = F.col("base_failed")
    for r in RULES:
        rejected = rejected | F.coalesce(over(r, F.col(f"_{r}")), F.lit(False))
    return rows.select(F.col("_id").alias(id_col), *FIGURES, "base_failed", (~rejected).alias("kept"))

"""Row windows per entity, and running figures over a whole log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.times import elapsed_minutes, epoch_micros, epoch_seconds
from tidewatch.operators.frames import forward_fill, framed, global_running, has_hot_entity, with_frames
from tidewatch.roles import DEFAULT_ROLES, Roles


def rolling_baseline(df: DataFrame, metrics: list[str], roles: Roles = DEFAULT_ROLES,
                     rows: int = 288, min_rows: int = 12, **kw) -> DataFrame:
    """Mean and population deviation of the ``rows`` rows before each row.

    The current row is excluded; the columns are NULL before ``min_rows`` rows.

    A sliding frame would redo all its rows for every row. Instead rows are cut
    into blocks of ``rows``: the frame of any row is the end of the block before
    plus the start of its own block. Both are running aggregates (one of them
    over the reversed order), and two sets of moments merge without the
    cancellation that differences of running sums would bring: a flat stretch
    keeps deviation 0.
    """
    f = framed(df, roles, back=rows, **kw)
    w = f.window()
    block = W.partitionBy(*f.keys, "_block")
    head = block.orderBy(*roles.order).rowsBetween(W.unboundedPreceding, -1)
    tail = block.orderBy(*[F.col(c).desc() for c in roles.order]).rowsBetween(
        W.unboundedPreceding, W.currentRow)

    def moments(frame, tag: str) -> dict[str, Column]:
        return {f"_{tag}{i}{k}": agg(m).over(frame) for i, m in enumerate(metrics)
                for k, agg in (("n", F.count), ("m", F.avg), ("v", F.var_pop))}

    out = f.df.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_block", F.floor(F.col("_pos") / rows))
    out = out.withColumns(moments(head, "h")).withColumns(moments(tail, "t"))
    names = [f"_t{i}{k}" for i in range(len(metrics)) for k in "nmv"]
    out = out.withColumns({n: F.lag(n, rows).over(w) for n in names})
    base: dict[str, Column] = {"base_rows": F.least(F.col("_pos"), F.lit(rows)).cast("bigint")}
    ready = base["base_rows"] >= min_rows
    for i, m in enumerate(metrics):
        n1, n2 = (F.coalesce(F.col(f"_{t}{i}n"), F.lit(0)).cast("double") for t in "ht")
        m1, m2 = (F.coalesce(F.col(f"_{t}{i}m"), F.lit(0.0)) for t in "ht")
        v1, v2 = (F.coalesce(F.col(f"_{t}{i}v"), F.lit(0.0)) for t in "ht")
        n = n1 + n2
        step = m2 - m1
        share = F.when(n > 0, n2 / n)
        base[f"{m}_base_mean"] = F.when(ready, m1 + step * share)
        base[f"{m}_base_std"] = F.when(ready, F.sqrt(F.try_divide(n1 * v1 + n2 * v2, n) + step * step * share * (1 - share)))
    helpers = ["_pos", "_block", *names, *[f"_h{i}{k}" for i in range(len(metrics)) for k in "nmv"]]
    return f.finish(out.withColumns(base).drop(*helpers))


def latest_rows(df: DataFrame, roles: Roles = DEFAULT_ROLES, columns: list[str] | None = None) -> DataFrame:
    """The newest row per entity, ties broken on all other columns.

    ``max`` of a struct is combined map-side, so a hot entity costs nothing.
    """
    rest = columns or [c for c in df.columns if c not in (roles.entity, *roles.order)]
    newest = df.groupBy(roles.entity).agg(F.max(F.struct(*roles.order, *rest)).alias("_r"))
    return newest.select(roles.entity, "_r.*").select(*[c for c in df.columns if c in {roles.entity, *roles.order, *rest}])


def last_rows(df: DataFrame, n: int, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """The newest ``n`` rows per entity; the rank limit also runs before the shuffle."""
    newest = W.partitionBy(roles.entity).orderBy(*[F.col(c).desc() for c in roles.order])
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def trailing_arrays(df: DataFrame, columns: list[str], roles: Roles = DEFAULT_ROLES, steps: int = 12,
                    **kw) -> DataFrame:
    """Up to ``steps`` rows ending at each row, oldest first, as ``sequence``."""
    f = framed(df, roles, back=steps - 1, **kw)
    w = f.window().rowsBetween(-(steps - 1), 0)
    row = F.array(*[F.col(c).cast("double") for c in columns])
    out = f.finish(f.df.withColumn("sequence", F.collect_list(row).over(w)))
    return out.select(roles.entity, *roles.order, "sequence")


def sequences(df: DataFrame, columns: list[str], roles: Roles = DEFAULT_ROLES, steps: int = 12,
              pad: bool = False, **kw) -> DataFrame:
    """The ``steps`` rows ending at each row as an array of arrays.

    Without ``pad`` rows with too little history are left out; with it the
    oldest step is repeated in front.
    """
    out = trailing_arrays(df, columns, roles, steps, **kw)
    if pad:
        return out.withColumn("sequence", pad_front(F.col("sequence"), steps))
    return out.where(F.size("sequence") == steps)


def pad_front(values: Column, n: int) -> Column:
    """Repeat the oldest value in front up to ``n``; longer arrays keep their last n."""
    padded = F.concat(F.array_repeat(values[0], F.greatest(F.lit(n) - F.size(values), F.lit(0))), values)
    return F.slice(padded, -n, n)


def supervised_windows(df: DataFrame, value: str, roles: Roles = DEFAULT_ROLES,
                       lookback: int = 20, horizon: int = 7, **kw) -> DataFrame:
    """(input, target): the last ``lookback`` values and the next ``horizon``."""
    f = framed(df, roles, back=lookback - 1, ahead=horizon, **kw)
    w = f.window()
    v = F.col(value).cast("double")
    out = f.finish(f.df.withColumns({
        "input": F.collect_list(v).over(w.rowsBetween(-(lookback - 1), 0)),
        "target": F.collect_list(v).over(w.rowsBetween(1, horizon)),
    }))
    return out.where((F.size("input") == lookback) & (F.size("target") == horizon)).select(
        roles.entity, *roles.order, "input", "target")


def hot_runs(df: DataFrame, score: str, threshold: float, roles: Roles = DEFAULT_ROLES,
             min_minutes: float = 2.0, **kw) -> DataFrame:
    """How long the current unbroken run of ``score >= threshold`` has lasted.

    A run starts at a hot row whose previous row is not hot; the last such start,
    carried forward, is the start of the run a hot row is in.
    """
    if kw.get("hot") is None:
        kw["hot"] = has_hot_entity(df, roles, kw.get("rows_per_task"))
    hot = F.col(score) >= threshold
    marked = with_frames(
        df.withColumn("_hot", F.coalesce(hot, F.lit(False))),
        lambda w: {"_start": F.when(
            F.col("_hot") & ~F.coalesce(F.lag("_hot", 1).over(w), F.lit(False)), F.col(roles.ts))},
        roles, back=1, **kw)
    out = forward_fill(marked, {"_start": "_run"}, roles, **kw)
    minutes = elapsed_minutes(F.col("_run"), F.col(roles.ts))
    return out.withColumns({
        "run_start": F.when(F.col("_hot"), F.col("_run")),
        "run_minutes": F.when(F.col("_hot"), minutes),
        "status": F.when(~F.col("_hot"), "cold").when(minutes < min_minutes, "waiting_persistence")
        .otherwise("verified"),
    }).drop("_hot", "_start", "_run")


def trailing_count(df: DataFrame, seconds: int, ts: str = "ts", by: tuple[str, ...] = (),
                   name: str = "recent") -> DataFrame:
    """Rows in the ``seconds`` up to and including each row, whole log or ``by`` key.

    Each row also visits the next time bucket, so the frame never leaves a
    bucket and no window spans the log.
    """
    width = int(seconds)
    t = epoch_micros(ts)
    bucket = F.floor(epoch_seconds(ts) / width)
    copies = df.withColumn("_us", t).withColumn("_home", bucket).withColumn(
        "_b", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = W.partitionBy(*by, "_b").orderBy("_us").rangeBetween(-width * 1_000_000, 0)
    return copies.withColumn(name, F.count(F.lit(1)).over(w)).where(F.col("_b") == F.col("_home")).drop(
        "_us", "_home", "_b")


def hour_bucket(ts: str) -> Column:
    return F.floor(epoch_seconds(ts) / 3600)


def prequential_accuracy(df: DataFrame, truth: str, predicted: str, roles: Roles = DEFAULT_ROLES,
                         every: int = 5000) -> DataFrame:
    """Accuracy so far in time order, one row per ``every`` rows seen."""
    marked = df.select(*roles.order, F.lit(1).alias("_one"),
                       (F.col(truth) == F.col(predicted)).cast("int").alias("_hit"))
    run = global_running(marked, {"_one": "n_seen", "_hit": "n_correct"}, roles.order, hour_bucket(roles.ts))
    return run.where(F.col("n_seen") % every == 0).select(
        "n_seen", "n_correct", (F.col("n_correct") / F.col("n_seen")).alias("accuracy"))


def rollback_rate(actions: DataFrame, max_rate_pct: float = 1.0, min_actions: int = 10,
                  roles: Roles | None = None) -> DataFrame:
    """Running rollback rate over an action log, and whether the breaker has tripped.

    Once tripped it stays tripped: the flag is a running maximum.
    """
    order = roles.order if roles else ["ts", "action_id"]
    bucket = hour_bucket(order[0])
    marked = actions.withColumns({"_one": F.lit(1), "_rb": (F.col("status") == "rolled_back").cast("int")})
    run = global_running(marked, {"_one": "n_actions", "_rb": "n_rolled_back"}, order, bucket)
    rate = F.col("n_rolled_back") * 100.0 / F.col("n_actions")
    run = run.withColumn("rollback_rate_pct", rate).withColumn(
        "_over", ((F.col("n_actions") >= min_actions) & (rate > max_rate_pct)).cast("int"))
    out = global_running(run, {}, order, bucket, maxima={"_over": "_tripped"})
    return out.withColumn("tripped", F.col("_tripped") == 1).drop("_one", "_rb", "_over", "_tripped")

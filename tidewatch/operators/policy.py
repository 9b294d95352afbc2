"""Policy decisions as queries over analysis, telemetry and action tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.numeric import capacity_fraction
from tidewatch.functions.times import epoch_seconds, from_epoch_seconds
from tidewatch.operators.frames import global_running, has_hot_entity, running_sum, with_frames
from tidewatch.operators.joins import within_after
from tidewatch.operators.topology import validate_migrations, with_best_target
from tidewatch.operators.windows import hour_bucket, rollback_rate
from tidewatch.roles import POLICY, Roles
from tidewatch.session import stage

# Gain credited to leaving a slow tier; which tiers are slow; the tier moved to.
TIER_GAIN = 50.0
SLOW_TIERS = ("HDD",)
FAST_TIER = "NVMe"
#: Requests that are folded in one place.
CHUNK_ROWS = 100_000
# Order in which equal gains are preferred.
ACTIONS = ["migrate", "qos", "tier_change"]


# --- choosing an action -------------------------------------------------------------------

def candidate_actions(hot: DataFrame, utilization: DataFrame, place: DataFrame, replica: DataFrame,
                      slow_tiers=SLOW_TIERS) -> DataFrame:
    """Three candidate rows per hot volume: migrate, cap IOPS, change tier.

    ``hot`` has volume_id, node_id, tier and victim_impact (the summed impact on
    its neighbours, NULL for none).
    """
    load = utilization.select("node_id", F.col("total_iops").alias("_source_iops"))
    aimed = with_best_target(hot, utilization).join(load, "node_id", "left")
    aimed = validate_migrations(aimed, place, replica)
    gain = F.greatest(F.coalesce(F.col("_source_iops") - F.col("target_iops"), F.lit(0.0)), F.lit(0.0))
    known = F.col("target_node").isNotNull()

    def option(action: str, target: Column, improvement: Column, safe: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), target.cast("string").alias("target"),
                        improvement.cast("double").alias("expected_improvement"), safe.alias("safe"))

    options = F.array(
        option("migrate", F.col("target_node"), F.when(known, gain).otherwise(0.0), known & F.col("allowed")),
        option("qos", F.lit(POLICY["iops_cap"]), F.coalesce("victim_impact", F.lit(0.0)), F.lit(True)),
        option("tier_change", F.lit(FAST_TIER), F.when(F.col("tier").isin(*slow_tiers), TIER_GAIN).otherwise(0.0), F.lit(True)))
    return aimed.select("volume_id", F.posexplode(options).alias("preference", "_o")).select("volume_id", "preference", "_o.*")


def best_action(candidates: DataFrame) -> DataFrame:
    """The safe candidate with the largest gain per volume, and whether to act."""
    rank = F.struct(F.col("expected_improvement"), -F.col("preference"))
    best = candidates.groupBy("volume_id").agg(
        F.max_by(F.struct("action", "target", "expected_improvement"), F.when(F.col("safe"), rank)).alias("_b"))
    gain = F.col("_b.expected_improvement")
    return best.select(
        "volume_id",
        F.when(F.col("_b").isNull(), "no_safe_actions").when(gain <= 0, "no_improvement").otherwise("selected").alias("status"),
        F.when(gain > 0, F.col("_b.action")).alias("action"), F.when(gain > 0, F.col("_b.target")).alias("target"),
        gain.alias("expected_improvement"))


# --- admission ----------------------------------------------------------------------------

def sessions(candidates: DataFrame, gap_seconds: int, roles: Roles, **kw) -> DataFrame:
    """Add ``session``: runs of rows per entity without a gap over ``gap_seconds``."""
    kw.setdefault("hot", has_hot_entity(candidates, roles, kw.get("rows_per_task")))
    t = epoch_seconds(roles.ts)
    marked = with_frames(candidates.withColumn("_s", t), lambda w: {
        "_new": (F.coalesce(F.col("_s") - F.lag("_s", 1).over(w), F.lit(gap_seconds + 1)) > gap_seconds).cast("int")},
        roles, back=1, **kw)
    return running_sum(marked, {"_new": "session"}, roles, **kw).drop("_s", "_new")


def _admission(times: Iterable[int], ran: deque[int], max_concurrent: int, max_per_hour: int, active: int) -> Iterator[tuple[str, str | None]]:
    """(status, reason) of each request in time order; ``ran`` holds the moves that count and is kept up."""
    hour = 3_600_000_000
    for us in times:
        while ran and ran[0] < us - max(hour, active):
            ran.popleft()
        if sum(r > us - active for r in ran) >= max_concurrent:
            yield "queued", "concurrent_limit"
        elif sum(r >= us - hour for r in ran) >= max_per_hour:
            yield "queued", "rate_limit"
        else:
            ran.append(us)
            yield "executed", None


def admit(candidates: DataFrame, max_concurrent: int = POLICY["max_concurrent"],
          max_per_hour: int = POLICY["max_moves_per_hour"], active_seconds: int = 300,
          roles: Roles = Roles(entity="cluster_id", ties=("action_id",)), chunk_rows: int = CHUNK_ROWS, **kw) -> DataFrame:
    """Run migrations as they come if the limits allow, else queue them.

    Whether one runs depends on those that ran before, so this is a fold in
    time order per cluster. After a quiet gap longer than both limits nothing is
    remembered, so each cluster is cut at such gaps into independent sessions, and
    a busy session into chunks of ``chunk_rows``. Every chunk is folded from an empty
    memory first; then those whose memory turns out to be another (the moves that the
    chunk before left, a few times at most) are folded again, until none changes.
    What a chunk leaves hardly depends on what it began with, so that is a round or
    two; at worst as many rounds as a session has chunks. No task folds more than a chunk.
    """
    gap, active = max(3600, active_seconds), active_seconds * 1_000_000
    cut = sessions(candidates, gap, roles, **kw).withColumn("_us", F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', {roles.ts})"))
    cut = running_sum(cut.withColumn("_one", F.lit(1)), {"_one": "_place"}, roles, **kw)
    keys = [roles.entity, "session", "_chunk"]
    ties, ts = list(roles.ties), roles.ts
    rows = stage(cut.withColumn("_chunk", F.floor((F.col("_place") - 1) / chunk_rows)).select(*keys, *ties, "_us", ts), "admission")
    limits = (max_concurrent, max_per_hour, active)
    types = dict(rows.dtypes)

    def left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", *ties], kind="stable")
        ran = deque([] if pdf["_memory"].iloc[0] is None else list(pdf["_memory"].iloc[0]))
        for _ in _admission(pdf["_us"], ran, *limits):
            pass
        return pdf.iloc[:1][keys].assign(_left=[list(ran)])

    ends_schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", _left array<bigint>"
    blank = F.lit(None).cast("array<bigint>")
    before = W.partitionBy(*keys[:2]).orderBy("_chunk")
    memory = stage(rows.select(*keys).distinct().withColumn("_memory", blank), "memory")
    again, ends = memory, None
    while True:
        new = rows.join(again, keys).groupBy(*keys).applyInPandas(left, ends_schema)
        if ends is not None:
            new = new.unionByName(ends.join(again.select(*keys), keys, "left_anti"))
        ends = stage(new, "ends")
        told = ends.withColumn("_memory", F.lag("_left").over(before)).select(*keys, "_memory")
        same = memory.select(*keys, F.col("_memory").alias("_was"))
        # an empty memory is none
        empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<bigint>"))
        changed = told.join(same, keys).where(empty("_memory") != empty("_was")).select(*keys, "_memory")
        again = stage(changed, "changed")
        if again.isEmpty():
            break
        memory = stage(told, "memory")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", *ties], kind="stable")
        ran = deque([] if pdf["_memory"].iloc[0] is None else list(pdf["_memory"].iloc[0]))
        out = list(_admission(pdf["_us"], ran, *limits))
        return pdf[[*keys[:2], *ties, ts]].assign(status=[s for s, _ in out], reason=pd.Series([r for _, r in out], index=pdf.index, dtype=object))

    schema = ", ".join(f"{c} {types[c]}" for c in [*keys[:2], *ties, ts]) + ", status string, reason string"
    return rows.join(memory, keys).groupBy(*keys).applyInPandas(fold, schema)


def drain_schedule(queued: DataFrame, max_per_hour: int = POLICY["max_moves_per_hour"], active_seconds: int = 300,
                   roles: Roles = Roles(entity="cluster_id", ties=("action_id",))) -> DataFrame:
    """When each queued migration can start, first come first served.

    One at a time (each active for ``active_seconds``), at most ``max_per_hour``
    per hour. The k-th start is the latest of its arrival, the start before plus
    the active time, and the start ``max_per_hour`` before plus an hour. Unrolled,
    that is the maximum over earlier arrivals j of ``A_j + cost(k - j)``, where
    every full round of ``max_per_hour`` costs an hour and every further move the
    active time: a running maximum per place within the round, no loop.
    """
    m, a = max_per_hour, active_seconds
    full = max(3600, m * a)
    order = roles.order
    bucket = hour_bucket(roles.ts)
    base = queued.withColumn("_one", F.lit(1)).withColumn("_at", epoch_seconds(roles.ts))
    k = global_running(base, {"_one": "_k"}, order, bucket, keys=[roles.entity]).withColumn("_k", F.col("_k") - 1)
    rounds, place = F.floor(F.col("_k") / m), F.col("_k") % m
    k = k.withColumns({f"_a{r}": F.when(place == r, F.col("_at") - rounds * full) for r in range(m)})
    run = global_running(k, {}, order, bucket, {f"_a{r}": f"_m{r}" for r in range(m)}, [roles.entity])
    starts = [F.col(f"_m{r}") + (rounds - (place < r).cast("int")) * full + ((place - r + m) % m) * a for r in range(m)]
    start = F.greatest(*starts) if m > 1 else starts[0]
    return run.select(*queued.columns, (F.col("_k") + 1).alias("queue_place"), from_epoch_seconds(start.cast("bigint")).alias("starts_at"))


# --- breaker, monitoring --------------------------------------------------------------------

def breaker_status(actions: DataFrame, max_rate_pct: float = POLICY["max_rollback_rate_pct"],
                   min_actions: int = POLICY["breaker_min_actions"], resets: DataFrame | None = None) -> DataFrame:
    """One row: whether the breaker is open, since when and why.

    After the last reset (a table with ``ts``) only later actions can trip it.
    """
    run = rollback_rate(actions, max_rate_pct, min_actions)
    over = (F.col("n_actions") >= min_actions) & (F.col("rollback_rate_pct") > max_rate_pct)
    if resets is not None:
        since = resets.agg(F.max("ts")).scalar()
        over = over & (F.col("ts") > F.coalesce(since, F.lit("1970-01-01").cast("timestamp_ntz")))
    at = F.struct("ts", "action_id")
    out = run.agg(
        F.min(F.when(over, F.col("ts"))).alias("tripped_at"),
        F.min_by("rollback_rate_pct", F.when(over, at)).alias("_rate_then"),
        F.max_by("rollback_rate_pct", at).alias("current_rate_pct"), F.max("n_actions").alias("total_actions"))
    why = F.format_string("rollback rate %.2f%% is over the limit of %.2f%%", F.col("_rate_then"), F.lit(float(max_rate_pct)))
    return out.select(F.col("tripped_at").isNotNull().alias("tripped"), "tripped_at",
                      F.when(F.col("tripped_at").isNotNull(), why).alias("reason"), "current_rate_pct", "total_actions")


def evaluate_actions(actions: DataFrame, samples: DataFrame, timeout_seconds: int = 300,
                     increase_pct: float = POLICY["rollback_increase_pct"], roles: Roles = Roles()) -> DataFrame:
    """Outcome of each action from the latencies after it.

    Rolled back at the first sample more than ``increase_pct`` over the latency
    before (at least 1), else successful once the timeout lies within the
    observed time, else still monitored. All times are event times.
    """
    before = F.greatest(F.col("pre_latency"), F.lit(1.0))
    after = within_after(actions.select("action_id", roles.entity, roles.ts, "pre_latency"),
                         samples.select(roles.entity, roles.ts, "avg_latency_us"), timeout_seconds, roles)
    bad = after.where((F.col("avg_latency_us") - before) / before * 100 > increase_pct).groupBy("action_id").agg(
        F.min(roles.ts).alias("rolled_back_at"), F.min_by("avg_latency_us", roles.ts).alias("latency_then"))
    seen_until = samples.agg(F.max(roles.ts)).scalar()
    done = F.col(roles.ts) + F.make_dt_interval(secs=F.lit(timeout_seconds).cast("decimal(18,6)")) <= seen_until
    out = actions.drop("status").join(bad, "action_id", "left")
    return out.withColumn("status", F.when(F.col("rolled_back_at").isNotNull(), "rolled_back").when(done, "success").otherwise("monitoring"))


def action_history(actions: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The log with each action's monitored outcome beside its logged status."""
    m = evaluated.select("action_id", F.col("status").alias("monitor_status"), "rolled_back_at")
    return actions.join(m, "action_id", "left")


# --- autoscale -------------------------------------------------------------------------------

def autoscale_triggers(capacity: DataFrame, days: DataFrame, place: DataFrame, now: Column | None = None,
                       last_run: Column | None = None, threshold_pct: float = POLICY["autoscale_capacity_pct"],
                       warning_days: float = POLICY["autoscale_warning_days"],
                       max_new: int = POLICY["autoscale_max_new"],
                       min_interval_hours: int = POLICY["autoscale_min_interval_hours"]) -> DataFrame:
    """Pools to grow: the fullest volume's when the fleet is full, then volumes soon full.

    ``capacity`` has the newest used share per volume, ``days`` the warning days.
    Nothing is due within ``min_interval_hours`` of the last run.
    """
    pct = capacity_fraction(F.col("capacity_used_pct")) * 100
    fleet = capacity.agg(F.avg(pct).alias("_avg"), F.max(F.struct(pct.alias("p"), "volume_id")).alias("_top")).where(
        F.col("_avg") >= threshold_pct).select(F.col("_top.volume_id").alias("volume_id"), F.lit("cluster_capacity").alias("reason"), F.lit(0).alias("_order"))
    soon = days.where(F.col("warning_days") <= warning_days).select("volume_id", F.lit("dtf_warning").alias("reason"), F.lit(1).alias("_order"))
    due = fleet.unionByName(soon).join(place.select("volume_id", F.col("pool_id").cast("string").alias("pool_id")), "volume_id", "left")
    due = due.withColumn("pool_id", F.coalesce("pool_id", F.lit("default_pool")))
    if last_run is not None:
        waited = F.timestamp_diff("SECOND", last_run, now) >= min_interval_hours * 3600
        due = due.where(F.coalesce(waited, F.lit(True)))
    return due.orderBy("_order", "volume_id").limit(max_new).drop("_order")


# --- requests ---------------------------------------------------------------------------------

def check_requests(requests: DataFrame, place: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Add ``problem`` to manual requests, NULL if acceptable.

    Requests have request_id, kind (migrate, qos, tier_change, rollback, reset),
    volume_id, target and, for a rollback, action_id.
    """
    known_v = place.select("volume_id").distinct().withColumn("_v", F.lit(True))
    known_n = nodes.select(F.col("node_id").cast("string").alias("target")).distinct().withColumn("_n", F.lit(True))
    known_a = actions.select("action_id").distinct().withColumn("_a", F.lit(True))
    out = requests.join(known_v, "volume_id", "left").join(known_n, "target", "left").join(known_a, "action_id", "left")
    kind = F.col("kind")
    act = kind.isin(*ACTIONS)
    problem = (
        F.when(~(act | kind.isin("rollback", "reset")), "unknown kind")
        .when(act & F.col("_v").isNull(), "unknown volume")
        .when((kind == "migrate") & F.col("_n").isNull(), "unknown node")
        .when((kind == "qos") & F.col("target").try_cast("double").isNull(), "cap is not a number")
        .when((kind == "rollback") & F.col("_a").isNull(), "unknown action"))
    return out.select(*requests.columns, problem.alias("problem"))


def append_requests(actions: DataFrame, checked: DataFrame) -> DataFrame:
    """The action log after the accepted requests: new actions added, rollbacks marked."""
    good = checked.where("problem IS NULL")
    undone = good.where("kind = 'rollback'").select("action_id").distinct().withColumn("_undo", F.lit(True))
    old = actions.join(undone, "action_id", "left").withColumn(
        "status", F.when(F.col("_undo"), "rolled_back").otherwise(F.col("status"))).drop("_undo")
    new = good.where(F.col("kind").isin(*ACTIONS)).select(
        F.col("request_id").alias("action_id"), "volume_id", "ts", F.col("kind").alias("action"), "target",
        F.lit(None).cast("double").alias("pre_latency"), F.lit("executed").alias("status"))
    return old.select(*new.columns).unionByName(new)

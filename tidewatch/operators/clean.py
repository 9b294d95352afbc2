"""Ingest and cleaning: duplicates, timestamps, gaps, events, outlier bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import capacity_fraction, clip, finite
from tidewatch.operators.frames import forward_fill, has_hot_entity
from tidewatch.operators.quantiles import quantile_table
from tidewatch.roles import DEFAULT_ROLES, Roles, require_columns

# Event columns that stay text.
TEXT_COLUMNS = ("volume_id", "node_id", "timestamp", "workload_label")
# Texts that mean "no value".
MISSING_TEXTS = ("", "None", "NaN", "nan")

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def parse_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Text to timestamp; rows whose text is no time are dropped."""
    parsed = F.col(column).try_cast("timestamp_ntz")
    return df.withColumn(column, parsed).where(F.col(column).isNotNull())


def fill_gaps(df: DataFrame, roles: Roles = DEFAULT_ROLES, columns: list[str] | None = None, **kw) -> DataFrame:
    """Carry each number forward per entity, then 0; never backward."""
    columns = columns or numeric_columns(df, skip=(roles.entity, roles.group, *roles.ties))
    clean = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c, t in df.dtypes
                            if c in columns and t in ("double", "float")})
    filled = forward_fill(clean, columns, roles, **kw)
    return filled.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def clean(df: DataFrame, roles: Roles = DEFAULT_ROLES, dealt: bool = False, **kw) -> DataFrame:
    """Duplicates out, unparsable times out, gaps filled.

    ``dealt`` says that the rows of an entity are in one partition already.
    """
    if kw.get("hot") is None:
        kw["hot"] = has_hot_entity(df, roles, kw.get("rows_per_task"))
    if not kw["hot"] and not dealt:
        # dealt by entity once, for the duplicates and for the windows that follow
        df = df.repartition(roles.entity)
    df = drop_duplicate_rows(df)
    if dict(df.dtypes)[roles.ts] == "string":
        df = parse_timestamps(df, roles.ts)
    return fill_gaps(df.where(F.col(roles.ts).isNotNull()), roles, **kw)


# --- events -----------------------------------------------------------------

def parse_events(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Flat JSON text to one text column per field.

    Numbers and quoted numbers read alike. ``_corrupt_record`` holds the text
    of a malformed event and is NULL otherwise.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*fields, "_corrupt_record"]])
    rest = [c for c in df.columns if c != column]
    out = df.withColumn("_e", F.from_json(column, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
        "allowNonNumericNumbers": "true"})).select(*rest, "_e.*")

    # A bare NaN or Infinity is read as a quoted text; take the quotes off.
    def bare(c: str) -> Column:
        return F.when(F.col(c).isin('"NaN"', '"Infinity"', '"-Infinity"'), F.replace(F.col(c), F.lit('"'), F.lit(""))).otherwise(F.col(c))

    return out.withColumns({f: bare(f) for f in fields})


def clip_event_texts(df: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Clip numeric texts to their bounds; NULL, other text, unlisted fields stay."""
    out = {}
    for c in low:
        if c in high and c in df.columns:
            x = F.col(c).try_cast("double")
            out[c] = (F.when(x < low[c], F.lit(str(float(low[c]))))
                      .when((x > high[c]) & ~F.isnan(x), F.lit(str(float(high[c])))).otherwise(F.col(c)))
    return df.withColumns(out)


def coerce_events(df: DataFrame, text=TEXT_COLUMNS, keep=()) -> DataFrame:
    """Text columns never NULL; every other column a finite-or-0 double."""
    out = {}
    for c in df.columns:
        if c in keep or c == "_corrupt_record":
            continue
        if c in text:
            out[c] = F.coalesce(F.col(c), F.lit(""))
        else:
            x = F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c).try_cast("double"))
            out[c] = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return df.withColumns(out)


def event_is_valid(df: DataFrame, entity: str = "volume_id", ts: str = "timestamp") -> Column:
    """Events need an entity and a readable time, and must have parsed."""
    ok = (F.coalesce(F.col(entity), F.lit("")) != "") & F.col(ts).try_cast("timestamp_ntz").isNotNull()
    if "_corrupt_record" in df.columns:
        ok = ok & F.col("_corrupt_record").isNull()
    return ok


def split_events(df: DataFrame, entity: str = "volume_id", ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events)."""
    ok = event_is_valid(df, entity, ts)
    return df.where(ok).drop("_corrupt_record"), df.where(~ok)


# --- bounds -----------------------------------------------------------------

def fit_iqr_bounds(train: DataFrame, columns: list[str], factor: float = 1.5, method: str = "exact") -> DataFrame:
    """(metric, low, high): quartiles widened by ``factor`` interquartile ranges."""
    require_columns(train, columns)
    q = quantile_table(train, columns, {"q1": 0.25, "q3": 0.75}, method=method)
    iqr = F.col("q3") - F.col("q1")
    return q.select("metric", (F.col("q1") - factor * iqr).alias("low"), (F.col("q3") + factor * iqr).alias("high"))


def bounds_scalar(bounds: DataFrame, columns: list[str]) -> Column:
    """The bounds table (one row per column) as one scalar struct."""
    picks = [F.max(F.when(F.col("metric") == c, F.col(side))).alias(f"{c}_{side}")
             for c in columns for side in ("low", "high")]
    return bounds.agg(F.struct(*picks).alias("b")).scalar()


def apply_bounds(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    # As a column the scalar is planned once, not once per use.
    out = df.withColumn("_b", bounds_scalar(bounds, columns))
    return out.withColumns({
        c: clip(F.col(c).cast("double"), F.col(f"_b.{c}_low"), F.col(f"_b.{c}_high")) for c in columns}).drop("_b")


def clip_columns(df: DataFrame, low: dict[str, float], high: dict[str, float]) -> DataFrame:
    """Clip numeric columns to given bounds."""
    return df.withColumns({
        c: clip(F.col(c), float(low[c]), float(high[c])) for c in low if c in high and c in df.columns})


def capacity_to_fraction_table(df: DataFrame, column: str = "capacity_used_pct") -> DataFrame:
    """If any value exceeds 1 the whole column is a percentage."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(column, F.when(top > 1, F.col(column) / 100).otherwise(F.col(column)))


def capacity_to_fraction_value(df: DataFrame, column: str = "capacity_used_pct") -> DataFrame:
    return df.withColumn(column, capacity_fraction(F.col(column)))


def impute_median(df: DataFrame, columns: list[str], method: str = "exact", rescan: bool = False) -> DataFrame:
    """NULL, NaN and infinite values become the median of the finite ones, 0 if none."""
    clean_df = df.withColumns({c: finite(F.col(c)) for c in columns})
    med = quantile_table(clean_df, columns, {"median": 0.5}, method=method, rescan=rescan)
    m = med.agg(F.struct(*[
        F.max(F.when(F.col("metric") == c, F.col("median"))).alias(c) for c in columns]).alias("m")).scalar()
    return clean_df.withColumn("_m", m).withColumns({
        c: F.coalesce(F.col(c), F.col(f"_m.{c}"), F.lit(0.0)) for c in columns}).drop("_m")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: NULLs (NaN counts as NULL), infinite values, rows."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        floating = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        null = c.isNull() | F.isnan(c) if floating else c.isNull()
        inf = (F.abs(c) == float("inf")) if floating else F.lit(False)
        aggs += [F.count_if(null).alias(f"_n{i}"), F.count_if(F.coalesce(inf, F.lit(False))).alias(f"_i{i}")]
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"_n{i}").alias("nulls"),
                 F.col(f"_i{i}").alias("infinite"), F.col("_rows").alias("n_rows"))
        for i, f in enumerate(df.schema.fields)])
    return df.agg(*aggs).select(F.explode(cells).alias("_p")).select("_p.*")


def validate_features(df: DataFrame, label: str, expected_labels: list, expected_rows: int) -> DataFrame:
    """One row: missing and infinite cells, whether labels and row count are as expected."""
    cells = profile(df).agg(F.sum("nulls").alias("nulls"), F.sum("infinite").alias("infinite"),
                            F.max("n_rows").alias("n_rows"))
    wanted = list(dict.fromkeys(expected_labels))
    other = F.count_if(F.col(label).isNotNull() & ~F.col(label).isin(*wanted)) == 0
    missing = [F.count_if(F.col(label) == x) > 0 for x in wanted]
    found = df.agg(F.coalesce(reduce(lambda a, b: a & b, missing, other), F.lit(False)).alias("ok")).scalar()
    return cells.select(
        "nulls", "infinite", "n_rows", (F.col("n_rows") == expected_rows).alias("rows_ok"),
        found.alias("labels_ok"))

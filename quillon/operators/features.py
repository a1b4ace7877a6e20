"""Feature rows: expressions, reads at a point in time, validation, catalog and freshness."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quillon.functions.expressions import feature_column
from quillon.functions.paths import nested
from quillon.session import dropped, scratch


# -- expressions and extraction ---------------------------------------------------------------


def entity_column(df: DataFrame) -> str:
    return "entity_id" if "entity_id" in df.columns else df.columns[0]


def with_features(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Add one column per `name: expression`."""
    return df.select("*", *[feature_column(text, df.columns).alias(name) for name, text in expressions.items()])


def feature_rows(df: DataFrame, expressions: dict[str, str], timestamp: Column | None = None) -> DataFrame:
    """Long feature rows (entity_id, feature_name, value, timestamp); the value is JSON text."""
    entity = F.col(entity_column(df)).cast("string").alias("entity_id")
    stamp = (F.current_timestamp() if timestamp is None else timestamp).alias("timestamp")
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("feature_name"), feature_column(text, df.columns).cast("string").alias("value"))
            for name, text in expressions.items()
            if name and text
        ]
    )
    return df.select(entity, stamp, F.explode(pairs).alias("f")).select(
        "entity_id", "f.feature_name", "f.value", "timestamp"
    )


def event_features(df: DataFrame, mapping: dict[str, str], type_column: str, service_column: str, time_column: str) -> DataFrame:
    """Named payload paths plus type, service, hour and weekday (Monday is 0)."""
    return df.select(
        *df.columns,
        *[nested(df, path).alias(name) for name, path in mapping.items()],
        F.col(type_column).alias("feature_event_type"),
        F.col(service_column).alias("feature_source_service"),
        F.hour(time_column).alias("timestamp_hour"),
        F.weekday(time_column).alias("timestamp_day_of_week"),
    )


def feature_vector(names: list[str], columns: list[str]) -> Column:
    """The named features in order, as doubles; a missing one is 0."""
    return F.array(
        *[F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0) for name in names]
    )


Computer = Callable[[dict[str, Column]], Column]


def derived_features(
    df: DataFrame, computers: dict[str, tuple[list[str], Computer]], requested: list[str]
) -> DataFrame:
    """Add the requested features, each after those of its dependencies that are also requested."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done or name in open_:
            return
        open_.add(name)
        for dependency in computers.get(name, ([], None))[0]:
            if dependency in requested:
                visit(dependency)
        open_.discard(name)
        done.append(name)

    for name in requested:
        visit(name)
    for name in done:
        if name in computers:
            needs, compute = computers[name]
            inputs = {n: F.col(n) if n in df.columns else F.lit(None) for n in needs}
            df = df.withColumn(name, compute(inputs))
    return df


def session_minutes(inputs: dict[str, Column]) -> Column:
    micros = F.unix_micros(inputs["last_activity_time"].cast("timestamp")) - F.unix_micros(
        inputs["session_start_time"].cast("timestamp")
    )
    return F.coalesce(micros / F.lit(60_000_000.0), F.lit(0.0))


def popularity_score(inputs: dict[str, Column]) -> Column:
    views = F.coalesce(inputs["view_count"].cast("double"), F.lit(0.0))
    rating = F.coalesce(inputs["rating"].cast("double"), F.lit(0.0))
    return views * 0.7 + rating * 10 * 0.3


def affinity_score(inputs: dict[str, Column]) -> Column:
    same = inputs["user_category_preference"].eqNullSafe(inputs["item_category"])
    return F.when(same, F.lit(1.0)).otherwise(F.lit(0.3))


# -- reads ------------------------------------------------------------------------------------


def _stamp(moment: dt.datetime | str) -> Column:
    return F.lit(moment).cast("timestamp")


def read_valid_at(
    values: DataFrame, names: list[str], entities: DataFrame | list[str], as_of: dt.datetime | str | None = None
) -> DataFrame:
    """Wide features of the requested entities from rows valid at `as_of`.

    A row counts while `valid_from <= as_of < valid_until` (open end when null); the latest
    `created_at` wins. Each feature is a conditional max over (created_at, value), combined
    before the one shuffle on the entity, so the reads of a hot entity stay small.
    """
    rows = values.filter(F.col("feature_name").isin(names))
    if as_of is not None:
        moment = _stamp(as_of)
        rows = rows.filter(
            (F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (F.col("valid_until") > moment))
        )
    if isinstance(entities, list):
        rows = rows.filter(F.col("entity_id").isin(entities))
        entities = values.sparkSession.createDataFrame([(e,) for e in entities], "entity_id string")
    latest = rows.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("feature_name") == name, F.struct("created_at", "feature_value")))
            .getField("feature_value")
            .alias(name)
            for name in names
        ]
    )
    return entities.select("entity_id").join(latest, "entity_id", "left")


def read_latest(values: DataFrame, names: list[str], as_of: dt.datetime | str | None = None) -> DataFrame:
    """Long form: the latest value per feature and entity with `timestamp <= as_of`."""
    rows = values.filter(F.col("feature_name").isin(names))
    if as_of is not None:
        rows = rows.filter(F.col("timestamp") <= _stamp(as_of))
    return (
        rows.groupBy("feature_name", "entity_id")
        .agg(F.max(F.struct("timestamp", "value")).alias("latest"))
        .select("feature_name", "entity_id", F.col("latest.value").alias("value"), F.col("latest.timestamp").alias("timestamp"))
    )


def serve(
    values: DataFrame,
    names: list[str],
    entities: DataFrame,
    defaults: dict[str, object],
    as_of: dt.datetime | str | None = None,
) -> DataFrame:
    """One row per entity with its latest values; a feature never written takes its default."""
    rows = values.filter(F.col("feature_name").isin(names))
    if as_of is not None:
        rows = rows.filter(F.col("timestamp") <= _stamp(as_of))
    wide = rows.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("feature_name") == name, F.struct("timestamp", "value"))).alias(name)
            for name in names
        ]
    )
    joined = entities.select("entity_id").join(wide, "entity_id", "left")
    default = {name: F.lit(None if defaults.get(name) is None else str(defaults[name])) for name in names}
    return joined.select(
        "entity_id",
        *[F.when(F.col(name).isNotNull(), F.col(name).getField("value")).otherwise(default[name]).alias(name) for name in names],
    )


def enrich_events(events: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Overlay stored features on event features: where both have a value the stored one wins.

    `stored` has one row per key, so a hot key only makes the event side long and the adaptive
    skew join can split it.
    """
    shared = [c for c in stored.columns if c != key]
    renamed = stored.select(key, *[F.col(c).alias(f"_stored_{c}") for c in shared])
    joined = events.join(renamed, key, "left")
    overlaid = [
        F.coalesce(F.col(f"_stored_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in events.columns
    ]
    added = [F.col(f"_stored_{c}").alias(c) for c in shared if c not in events.columns]
    return joined.select(*overlaid, *added)


# -- validation -------------------------------------------------------------------------------


def null_shares(rows: DataFrame, max_share: float = 0.1, value: str = "value") -> DataFrame:
    """Null share per feature over the whole write, and whether it passes."""
    share = F.avg(F.col(value).isNull().cast("double"))
    return (
        rows.groupBy("feature_name")
        .agg(F.count(F.lit(1)).alias("value_count"), share.alias("null_share"))
        .withColumn("is_valid", F.col("null_share") <= F.lit(max_share))
    )


# The JSON types that each declared feature type accepts.
ACCEPTED_JSON = {
    "string": "^STRING$",
    "integer": "^(BIGINT|BOOLEAN)$",
    "float": "^(BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$",
    "boolean": "^BOOLEAN$",
    "timestamp": "^STRING$",
}


def validate_values(rows: DataFrame, definitions: DataFrame, value: str = "value") -> DataFrame:
    """Check JSON values against (feature_name, feature_type, min_value, max_value, max_length).

    Adds `errors` (array of text) and `is_valid`. Definitions are one row per feature.
    """
    joined = rows.join(definitions, "feature_name", "left")
    parsed = F.try_parse_json(F.col(value))
    kind = F.schema_of_variant(parsed)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.col(value).try_cast("double"))
    text = F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))
    checks = [
        F.when((F.col("feature_type") == declared) & ~F.coalesce(kind.rlike(accepted), F.lit(False)), F.lit(f"expected {declared}"))
        for declared, accepted in ACCEPTED_JSON.items()
    ]
    checks += [
        F.when(number < F.col("min_value"), F.lit("below minimum")),
        F.when(number > F.col("max_value"), F.lit("above maximum")),
        F.when(F.length(text) > F.col("max_length"), F.lit("too long")),
    ]
    return joined.withColumn("errors", F.array_compact(F.array(*checks))).withColumn(
        "is_valid", F.size("errors") == 0
    )


# -- catalog ----------------------------------------------------------------------------------


def catalog_counts(definitions: DataFrame, by: str, values: list[str] | None = None) -> DataFrame:
    """Definitions per type, status or group; given values appear with 0 when absent."""
    counted = definitions.groupBy(by).agg(F.count(F.lit(1)).alias("feature_count"))
    if values is None:
        return counted
    spine = definitions.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    return spine.join(counted, by, "left").na.fill(0, ["feature_count"])


def recent_counts(df: DataFrame, now: dt.datetime | str, days: int, column: str = "created_at") -> DataFrame:
    """How many rows there are, and how many are newer than `days` before `now`."""
    cutoff = _stamp(now) - F.make_dt_interval(days=F.lit(days))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(column) > cutoff).alias("recent"),
    )


def list_features(
    definitions: DataFrame, feature_type: str | None = None, owner: str | None = None, tags: list[str] | None = None
) -> DataFrame:
    """Definitions by type, owner and any of the tags (array column)."""
    rows = definitions
    if feature_type:
        rows = rows.filter(F.col("feature_type") == feature_type)
    if owner:
        rows = rows.filter(F.col("owner") == owner)
    if tags:
        rows = rows.filter(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags])))
    return rows


def retained(values: DataFrame, now: dt.datetime | str, days: int = 90, column: str = "created_at") -> DataFrame:
    """Drop the values older than `days`; write the result over the store to apply it."""
    return values.filter(F.col(column) >= _stamp(now) - F.make_dt_interval(days=F.lit(days)))


def stored_by_day(values: DataFrame, folder: str, column: str = "created_at") -> None:
    """Appends values to a store with one folder per day of `column`, which retention can then apply to."""
    values.withColumn("day", F.to_date(column)).write.mode("append").partitionBy("day").parquet(folder)


def apply_retention(spark: SparkSession, folder: str, now: dt.datetime | str, days: int = 90, column: str = "created_at") -> int:
    """Removes the values older than `days` from a store by day, and returns how many there were.

    Folders of days that are wholly too old go. The one day that the limit falls in is rewritten with what it keeps, by
    an overwrite of that folder alone; no file of a later day, or of values without a time, is touched.
    """
    limit = _stamp(now) - F.make_dt_interval(days=F.lit(days))
    edge = spark.range(1).select(F.to_date(limit)).first()[0]
    store = spark.read.parquet(folder)
    old = store.where(F.col("day") <= F.lit(edge))
    removed = old.where(F.col(column) < limit).count()
    gone = [row[0] for row in old.where(F.col("day") < F.lit(edge)).select("day").distinct().collect()]
    with scratch(spark, "retention") as keep:
        kept = keep(old.where((F.col("day") == F.lit(edge)) & (F.col(column) >= limit)))
        if not kept.isEmpty():
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
        elif not old.where(F.col("day") == F.lit(edge)).isEmpty():
            gone.append(edge)
    for day in gone:
        dropped(spark, f"{folder}/day={day}")
    return removed


def freshness(values: DataFrame, now: dt.datetime | str, max_age_seconds: int, column: str = "timestamp") -> DataFrame:
    """Age of the newest value per feature and entity, and whether it is fresh."""
    newest = values.groupBy("feature_name", "entity_id").agg(F.max(column).alias("newest"))
    age = (F.unix_micros(_stamp(now)) - F.unix_micros(F.col("newest").cast("timestamp"))) / F.lit(1_000_000.0)
    return newest.withColumn("age_seconds", age).withColumn("is_fresh", F.col("age_seconds") <= max_age_seconds)

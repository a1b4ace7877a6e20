"""Event records as JSON text: decoding, checks, and the split into good and bad."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the event format.
EVENT_TYPES = ["user_action", "system_event", "business_event", "ml_prediction", "data_quality", "alert", "metric"]
SEVERITIES = ["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"]
METRIC_TYPES = ["counter", "gauge", "histogram", "summary"]
ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
SCHEMA_NAMES = ["base_event", "user_action", "system_event", "ml_prediction", "business_event", "metric_event"]
TEXT_FIELDS = [
    "event_id", "event_type", "event_name", "source_service", "source_version", "trace_id", "span_id",
    "parent_span_id", "schema_version", "user_id", "session_id", "action", "component", "severity",
    "model_name", "model_version", "entity_type", "entity_id", "currency", "metric_name", "metric_type", "unit",
]
NUMBER_FIELDS = ["confidence_score", "value", "metric_value"]
REQUIRED = {
    "base_event": ["event_type", "event_name", "source_service"],
    "user_action": ["event_name", "source_service", "user_id", "session_id", "action"],
    "system_event": ["event_name", "source_service", "component"],
    "ml_prediction": ["event_name", "source_service", "model_name", "model_version"],
    "business_event": ["event_name", "source_service", "entity_type", "entity_id"],
    "metric_event": ["event_name", "source_service", "metric_name", "metric_type"],
}
DEFAULT_TYPE = {
    "user_action": "user_action",
    "system_event": "system_event",
    "ml_prediction": "ml_prediction",
    "business_event": "business_event",
    "metric_event": "metric",
}
DEFAULTS = {"source_version": "1.0.0", "schema_version": "1.0"}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body reads it.

    A plain column would be copied into every use when Catalyst pushes a filter on the result
    below the projection, and each copy would parse the JSON again.
    """
    return F.transform(F.array(value), body).getItem(0)


def decoded(value: Column) -> Column:
    """The event fields of a JSON text as one struct; `payload` and `metadata` stay JSON text.

    The time is parsed as a variant, since its JSON type matters; the other fields are text, so no wrong
    type can spoil a record.
    """
    kinds = [f"`{name}` string" for name in TEXT_FIELDS + NUMBER_FIELDS]
    kinds += ["`timestamp` variant", "payload string", "metadata string", "_broken string"]
    parsed = F.from_json(value.cast("string"), ", ".join(kinds), {"columnNameOfCorruptRecord": "_broken"})

    def fields(e: Column) -> Column:
        moment = F.variant_get(e["timestamp"], "$", "string")
        kind = F.schema_of_variant(e["timestamp"])
        timestamp = F.when(
            kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"),
            F.timestamp_micros((moment.try_cast("double") * 1_000_000).cast("long")),
        ).when((kind == "STRING") & moment.rlike(ISO_TIME), moment.try_cast("timestamp"))
        text = {name: F.coalesce(e[name], F.lit(DEFAULTS[name])) if name in DEFAULTS else e[name] for name in TEXT_FIELDS}
        return F.struct(
            (e.isNotNull() & e["_broken"].isNull()).alias("is_json"),
            moment.isNotNull().alias("has_timestamp"),
            timestamp.alias("event_time"),
            *[column.alias(name) for name, column in text.items()],
            *[e[name].try_cast("double").alias(name) for name in NUMBER_FIELDS],
            F.coalesce(F.json_object_keys(e["payload"]), F.array().cast("array<string>")).alias("payload_keys"),
            e["payload"].alias("payload"),
            e["metadata"].alias("metadata"),
        )

    return _bound(parsed, fields)


def event_errors(event: Column, schema_name: str = "base_event") -> Column:
    """Array of the problems of a decoded event under a named schema; empty when it is valid."""
    if schema_name not in SCHEMA_NAMES:
        raise ValueError(f"Unknown schema: {schema_name}")

    def problem(test: Column, message: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(message))

    def checks(e: Column) -> Column:
        present, filled = e["is_json"], F.size(e["payload_keys"]) > 0
        event_type = F.coalesce(e["event_type"], F.lit(DEFAULT_TYPE.get(schema_name)))
        found = [problem(~present, "not json")]
        found += [problem(present & e[name].isNull(), f"missing {name}") for name in REQUIRED[schema_name]]
        found += [
            problem(present & ~event_type.isin(EVENT_TYPES), "unknown event_type"),
            problem(present & e["has_timestamp"] & e["event_time"].isNull(), "bad timestamp"),
            problem(present & ~filled, "empty payload"),
        ]
        if schema_name == "user_action":
            found += [
                problem(present & filled & ~F.array_contains(e["payload_keys"], name), f"payload without {name}")
                for name in ("page", "element")
            ]
        if schema_name == "system_event":
            found.append(problem(present & ~F.upper(e["severity"]).isin(SEVERITIES), "unknown severity"))
        if schema_name == "ml_prediction":
            found.append(problem(~e["confidence_score"].between(0.0, 1.0), "confidence out of range"))
        if schema_name == "metric_event":
            found.append(problem(~F.lower(e["metric_type"]).isin(METRIC_TYPES), "unknown metric_type"))
            found.append(problem(present & e["metric_value"].isNull(), "missing metric_value"))
        return F.array_compact(F.array(*found))

    return _bound(event, checks)


def check_events(df: DataFrame, column: str = "value", schema_name: str = "base_event") -> DataFrame:
    """Add the decoded fields, `errors` and `is_valid`; severity and metric type get their normal case.

    A field whose name the input already uses comes out as `event_<name>`, such as `event_value`
    beside a record's `value`.
    """
    rows = df.withColumn("_event", decoded(F.col(column)))
    names = [n for n in rows.schema["_event"].dataType.names if n not in ("payload_keys", "is_json", "has_timestamp")]
    fields = [F.col(f"_event.{n}").alias(f"event_{n}" if n in df.columns else n) for n in names]
    rows = rows.select(*df.columns, *fields, event_errors(F.col("_event"), schema_name).alias("errors"))
    if schema_name in DEFAULT_TYPE:
        rows = rows.withColumn("event_type", F.coalesce("event_type", F.lit(DEFAULT_TYPE[schema_name])))
    if schema_name == "system_event":
        rows = rows.withColumn("severity", F.coalesce(F.upper("severity"), F.lit("INFO")))
    if schema_name == "metric_event":
        rows = rows.withColumn("metric_type", F.lower("metric_type"))
    return rows.withColumn("is_valid", F.size("errors") == 0)


def split_events(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected events."""
    return checked.filter("is_valid"), checked.filter(~F.col("is_valid"))


def route_events(valid: DataFrame) -> dict[str, DataFrame]:
    """One filtered DataFrame per event type. Each reads `valid` anew, so pass rows of a written table, not ones still to be decoded."""
    return {name: valid.filter(F.col("event_type") == name) for name in EVENT_TYPES}

"""Quality alerts from suite summaries, and the cooldown between alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.session import scratch, stored


@dataclass(frozen=True)
class QualityRule:
    """`min_success_rate` is a percentage. Any condition that holds raises the alert."""

    id: str
    severity: str
    min_success_rate: float | None = None
    max_failures: int | None = None
    expectation_types: tuple[str, ...] = ()
    cooldown_minutes: int = 60
    enabled: bool = True


def default_rules() -> list[QualityRule]:
    return [
        QualityRule("low_success_rate", "high", min_success_rate=95.0),
        QualityRule("multiple_failures", "medium", max_failures=5),
        QualityRule(
            "critical_expectations",
            "critical",
            expectation_types=(
                "expect_column_values_to_not_be_null",
                "expect_column_values_to_be_unique",
                "expect_table_row_count_to_be_between",
            ),
            cooldown_minutes=30,
        ),
    ]


def quality_alerts(summaries: DataFrame, rules: list[QualityRule]) -> DataFrame:
    """One row per suite summary and rule that fires.

    `summaries` has success_rate (a fraction), failure_count and failed_types. The rules are a
    short list, so they are columns of one pass, not a joined table.
    """
    raised = []
    for rule in rules:
        if not rule.enabled:
            continue
        tests = []
        if rule.min_success_rate is not None:
            tests.append(F.col("success_rate") * 100 < rule.min_success_rate)
        if rule.max_failures is not None:
            tests.append(F.col("failure_count") > rule.max_failures)
        if rule.expectation_types:
            tests.append(F.arrays_overlap("failed_types", F.array(*[F.lit(t) for t in rule.expectation_types])))
        if tests:
            fires = reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test in tests])
            raised.append(
                F.when(
                    fires,
                    F.struct(
                        F.lit(rule.id).alias("rule_id"),
                        F.lit(rule.severity).alias("severity"),
                        F.lit(rule.cooldown_minutes).alias("cooldown_minutes"),
                    ),
                )
            )
    return summaries.select("*", F.explode(F.array_compact(F.array(*raised))).alias("_rule")).select(
        *summaries.columns, "_rule.*"
    )


def with_cooldown(alerts: DataFrame, keys: list[str], time: str, cooldown_minutes: str, tie: str) -> DataFrame:
    """Add `emitted`: an alert is held back while the last *emitted* one of its key is too recent.

    After a pause of at least the cooldown the next alert is always emitted and begins a burst. Within a burst each time
    points to the first one a cooldown later; those that the pointers reach from its beginning are emitted. They are found
    by doubling the pointers, so the rounds grow with the logarithm of the longest burst. Times are looked up inside
    slices one cooldown wide, so a burst is spread over its slices. `tie` must be unique; it picks among equal times.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    width = F.greatest(F.col(cooldown_minutes), F.lit(0)).cast("long") * 60_000_000
    rows = alerts.withColumn("_us", micros).withColumn("_width", width)
    held = rows.filter(F.col("_width") > 0)
    own = [*keys, "_width"]
    with scratch(alerts.sparkSession, "cooldown") as keep:
        slice_ = F.floor(F.col("_us") / F.col("_width"))
        times = keep(held.groupBy(*own, "_us").agg(F.min(tie).alias("_tie")).withColumn("_slice", slice_))
        chosen = stored(_emitted(times, own, keep), "emitted")
    mark = [*keys, "_us", "_tie"]
    marked = held.withColumn("_tie", F.col(tie)).join(
        chosen.select(*[F.col(n).alias(f"_e_{n}") for n in mark]), _same(mark, "_e_"), "left"
    )
    flagged = marked.select(*alerts.columns, F.col("_e__us").isNotNull().alias("emitted"))
    free = rows.filter(F.col("_width") <= 0)
    return flagged.unionByName(free.select(*alerts.columns, F.lit(True).alias("emitted")))


def _emitted(times: DataFrame, own: list[str], keep) -> DataFrame:
    """The rows of `times` (own, _slice, _us, _tie) that are a cooldown or more after the emitted one before them."""
    by_slice = Window.partitionBy(*own).orderBy("_slice")
    slices = times.groupBy(*own, "_slice").agg(F.min("_us").alias("_low"), F.max("_us").alias("_high"))
    beside = {"_earlier": F.lag("_high"), "_later": F.lead("_slice"), "_later_low": F.lead("_low"), "_second_low": F.lead("_low", 2)}
    slices = slices.select(*own, "_slice", *[value.over(by_slice).alias(name) for name, value in beside.items()])
    place = [*own, "_slice"]
    looked = times.join(slices.select(*[F.col(n).alias(f"_b_{n}") for n in place], *beside), _same(place, "_b_")).select(*times.columns, *beside)
    inside = Window.partitionBy(*place).orderBy("_us")
    before = F.coalesce(F.lag("_us").over(inside), "_earlier")
    opens = F.coalesce(F.col("_us") - before >= F.col("_width"), F.lit(True))
    looked = keep(looked.withColumn("_opens", opens))

    # A cooldown later is in the next slice; if nothing there comes at or after it, the slice after that begins with it.
    after = F.when(F.col("_later") == F.col("_slice") + 1, F.col("_second_low")).otherwise(F.col("_later_low"))
    asks = looked.select(*own, (F.col("_slice") + 1).alias("_slice"), (F.col("_us") + F.col("_width")).alias("_at"), F.col("_us").alias("_from"), after.alias("_after"))
    spots = looked.select(*place, F.col("_us").alias("_at"), F.lit(None).cast("long").alias("_from"), F.lit(None).cast("long").alias("_after"))
    backwards = Window.partitionBy(*place).orderBy(F.desc("_at"), F.col("_from").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_from").isNull(), F.col("_at")), ignorenulls=True).over(backwards)
    pointers = spots.unionByName(asks).withColumn("_hit", F.coalesce(hit, "_after")).where("_from IS NOT NULL AND _hit IS NOT NULL").select(*own, "_from", "_hit")
    first = looked.where("_opens").select(*[F.col(n).alias(f"_s_{n}") for n in own], F.col("_us").alias("_s_us"))
    jumps = keep(pointers.join(first, _same(own, "_s_") & (F.col("_hit") == F.col("_s_us")), "left_anti"))

    # A round knows what is reached in up to 4 ** k steps, and pointers of that length; it follows them up to three times.
    reached = [looked.where("_opens").select(*own, "_us")]
    while True:
        named = lambda df, p: df.select(*[F.col(n).alias(f"{p}{n}") for n in own], F.col("_from").alias(f"{p}from"), F.col("_hit").alias(f"{p}hit"))
        onward = lambda df: df.join(named(jumps, "_j_"), _same(own, "_j_") & (F.col("_hit") == F.col("_j_from"))).select(*own, "_from", F.col("_j_hit").alias("_hit"))
        far = keep(jumps.withColumn("_times", F.lit(1)).unionAll(onward(jumps).withColumn("_times", F.lit(2))))
        twice = far.where("_times = 2").drop("_times")
        thrice = onward(twice).withColumn("_times", F.lit(3))
        known = reduce(DataFrame.unionAll, reached)
        steps = named(far.unionAll(thrice), "_s_")
        found = keep(known.join(steps, _same(own, "_s_") & (F.col("_us") == F.col("_s_from"))).select(*own, F.col("_s_hit").alias("_us")))
        if found.isEmpty():
            break
        reached.append(found)
        again = named(twice, "_j_")
        jumps = keep(twice.join(again, _same(own, "_j_") & (F.col("_hit") == F.col("_j_from"))).select(*own, "_from", F.col("_j_hit").alias("_hit")))
        if jumps.isEmpty():
            break
    reached = reduce(DataFrame.unionAll, reached)
    final = reached.select(*[F.col(n).alias(f"_r_{n}") for n in [*own, "_us"]])
    return times.join(final, _same([*own, "_us"], "_r_"), "left_semi")


def _same(names: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names])

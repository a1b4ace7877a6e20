"""Model monitoring: the first half of the month is the reference, the second is current."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import drift, models
from quillon.plans.features import CATEGORIES, HALVES, _categories, halves
from quillon.plans.registry import query, rounded, table
from quillon.plans.trials import chi_square_tail_sql


def _by_type(df):
    return df.select(F.col("event_type").alias("feature_name"), "value")


def _two_halves(spark, folder):
    return [_by_type(df) for df in halves(spark, folder)]


@query("ks_per_feature", HALVES + """
, x AS (SELECT event_type AS f, value AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY ALL),
c AS (SELECT f, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM x WINDOW w AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f))
, g AS (SELECT f, max(gap) AS gap, max(na)::BIGINT AS na, max(nb)::BIGINT AS nb, max(gap) * sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS x FROM c GROUP BY f)
SELECT f AS feature_name, round(gap, 8) AS statistic, na AS reference_samples, nb AS current_samples,
  round(CASE WHEN x < 0.2 THEN 1 ELSE least(1, 2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x) FOR k IN range(1, 100)])) END, 7) AS p_value FROM g""")
def ks_per_feature(spark, folder):
    made = drift.kolmogorov_smirnov(*_two_halves(spark, folder), exact_up_to=0)
    return rounded(rounded(made, 8, "statistic"), 7, "p_value")


@query("ks_exact", """
WITH RECURSIVE d AS (SELECT n_name AS f, c_acctbal AS v, true AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, s_acctbal, false FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT f, v, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM d GROUP BY ALL),
c AS (SELECT f, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap, sum(a) OVER p AS m, sum(b) OVER p AS n FROM x WINDOW w AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f)),
g AS (SELECT f, max(gap) AS gap, max(m)::BIGINT AS m, max(n)::BIGINT AS n, (floor(max(gap) * max(m) * max(n) - 1e-7) + 0.5) / (max(m) * max(n)) AS most FROM c GROUP BY f HAVING max(m) >= 5 AND max(n) >= 5),
l AS (SELECT f, m, n, most, 0::BIGINT AS i, [CASE WHEN j / n > most THEN 0.0::DOUBLE ELSE 1.0 END FOR j IN range(0, n + 1)] AS u FROM g
  UNION ALL SELECT f, m, n, most, i + 1, [CASE WHEN abs((i + 1) / m - j / n) > most THEN 0.0::DOUBLE
    ELSE coalesce(list_sum([u[k + 1] * (i + 1) / (i + 1 + n) FOR k IN range(0, j + 1) IF abs((i + 1) / m - k / n) <= most]), 0.0) END FOR j IN range(0, n + 1)] FROM l WHERE i < m)
SELECT g.f AS feature_name, round(gap, 8) AS statistic, g.m AS reference_samples, g.n AS current_samples, round(greatest(0, least(1, 1 - u[g.n + 1])), 8) AS p_value FROM g JOIN l ON l.f = g.f AND l.i = g.m""")
def ks_exact(spark, folder):
    """Balances of customers against suppliers, nation by nation, with every path counted."""
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("feature_name"))
    side = lambda name, key, value: table(spark, folder, name).join(nation, F.col(key) == F.col("n_nationkey")).select("feature_name", F.col(value).alias("value"))
    made = drift.kolmogorov_smirnov(side("customer", "c_nationkey", "c_acctbal"), side("supplier", "s_nationkey", "s_acctbal"))
    made = made.where((F.col("reference_samples") >= 5) & (F.col("current_samples") >= 5))
    return rounded(made, 8, "statistic", "p_value")


@query("categorical_chi_square", CATEGORIES + """
, q AS (SELECT f, sum((xn - pb * tn) ** 2 / (pb * tn)) AS x, (count(*) - 1)::DOUBLE AS df, max(tb)::BIGINT AS tb, max(tn)::BIGINT AS tn FROM p GROUP BY f)
SELECT f AS feature_name, round(x, 6) AS statistic, df AS degrees_of_freedom, tb AS reference_samples, tn AS current_samples,
  round(CASE WHEN df < 1 OR x <= 0 THEN 1 ELSE """ + chi_square_tail_sql("x", "df") + """ END, 7) AS p_value FROM q""")
def categorical_chi_square(spark, folder):
    made = drift.categorical_chi_square(*[_categories(df) for df in halves(spark, folder)])
    return rounded(rounded(made, 6, "statistic"), 7, "p_value")


@query("psi_numeric", HALVES + """
, n AS (SELECT event_type AS f, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS nr, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS nc FROM events GROUP BY ALL),
k AS (SELECT f, nr, nc, least(10, greatest(3, floor(sqrt(least(nr, nc)))))::INTEGER AS bins FROM n),
s AS (SELECT event_type AS f, list(value ORDER BY value) AS v FROM base GROUP BY ALL),
e AS (SELECT f, nr, nc, list_sort(list_distinct([v[1 + floor((nr - 1) * i / bins)::BIGINT] + ((nr - 1) * i / bins - floor((nr - 1) * i / bins))
    * (v[1 + ceil((nr - 1) * i / bins)::BIGINT] - v[1 + floor((nr - 1) * i / bins)::BIGINT]) FOR i IN range(0, bins + 1)])) AS edges FROM k JOIN s USING (f)),
h AS (SELECT f, edges, nr, nc, ts < TIMESTAMP '2024-01-16' AS is_ref, CASE WHEN value = edges[-1] THEN len(edges) - 1 ELSE len([x FOR x IN edges IF x <= value]) END AS bin FROM events JOIN e ON event_type = f),
g AS (SELECT f, any_value(nr) AS nr, any_value(nc) AS nc, bin, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM h WHERE bin BETWEEN 1 AND len(edges) - 1 GROUP BY f, bin),
q AS (SELECT *, CASE WHEN a = 0 THEN 1e-6 ELSE a / sum(a) OVER (PARTITION BY f) END AS pa, CASE WHEN b = 0 THEN 1e-6 ELSE b / sum(b) OVER (PARTITION BY f) END AS pb FROM g)
SELECT f AS feature_name, round(abs(sum((pb - pa) * ln(pb / pa))), 8) AS psi, any_value(nr) AS reference_samples, any_value(nc) AS current_samples FROM q GROUP BY f""")
def psi_numeric(spark, folder):
    return rounded(drift.numeric_psi(*_two_halves(spark, folder)), 8, "psi")


@query("psi_categorical", CATEGORIES + """
SELECT f AS feature_name, round(abs(sum((CASE WHEN xn = 0 THEN 1e-6 ELSE pn END - CASE WHEN xb = 0 THEN 1e-6 ELSE pb END)
  * ln(CASE WHEN xn = 0 THEN 1e-6 ELSE pn END / CASE WHEN xb = 0 THEN 1e-6 ELSE pb END))), 8) AS psi, max(tb)::BIGINT AS reference_samples, max(tn)::BIGINT AS current_samples FROM p GROUP BY f""")
def psi_categorical(spark, folder):
    return rounded(drift.categorical_psi(*[_categories(df) for df in halves(spark, folder)]), 8, "psi")


@query("input_drift_ks", HALVES + """
, d AS (SELECT 'value' AS f, value AS v, ts < TIMESTAMP '2024-01-16' AS r FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k')::DOUBLE, ts < TIMESTAMP '2024-01-16' FROM events),
x AS (SELECT f, v, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM d WHERE v IS NOT NULL GROUP BY ALL),
c AS (SELECT f, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM x WINDOW w AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f)),
g AS (SELECT f, max(gap) AS s, max(na)::BIGINT AS na, max(nb)::BIGINT AS nb, max(gap) * sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS z FROM c GROUP BY f),
ks AS (SELECT f, s, na, nb, CASE WHEN z < 0.2 THEN 1.0 ELSE least(1, greatest(0, list_sum([2 * (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * z * z) FOR k IN range(1, 101)]))) END AS p FROM g),
b2 AS (SELECT event_type AS c, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS xb, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS xn FROM events GROUP BY ALL),
e AS (SELECT xn, xb, xb * sum(xn) OVER () / sum(xb) OVER () AS want FROM b2),
cs AS (SELECT 'event_type' AS f, sum((xn - want) ** 2 / want) AS s, sum(xb)::BIGINT AS na, sum(xn)::BIGINT AS nb FROM e),
every AS (SELECT f, s, na, nb, p FROM ks UNION ALL SELECT f, s, na, nb, exp(-s / 2) * (1 + s / 2) FROM cs)
SELECT f AS feature_name, round(s, 8) AS statistic, round(p, 8) AS p_value, na AS reference_samples, nb AS current_samples, p < 0.05 AS drift_detected,
  CASE WHEN s < 0.1 THEN 'low' WHEN s < 0.25 THEN 'medium' WHEN s < 0.5 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN p < 0.05 THEN CASE WHEN s >= 0.25 THEN 'Immediate retraining recommended' WHEN s >= 0.1 THEN 'Monitor closely, consider retraining' ELSE 'Continue monitoring' END END AS recommended_action, 'checked' AS status FROM every""")
def input_drift_ks(spark, folder):
    base, now = [df.withColumn("k", F.get_json_object("props", "$.k").cast("double")) for df in halves(spark, folder)]
    made = drift.input_drift(base, now, ["value", "k"], ["event_type"], exact_up_to=0).drop("detection_method", "drift_magnitude")
    return rounded(made, 8, "statistic", "p_value")


@query("input_drift_psi", HALVES + """
, d AS (SELECT 'value' AS feature_name, value AS v, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events UNION ALL SELECT 'user_id', user_id::DOUBLE, ts < TIMESTAMP '2024-01-16' FROM events),
e AS (SELECT feature_name, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM d WHERE is_ref GROUP BY ALL),
h AS (SELECT feature_name, edges, is_ref, CASE WHEN v = edges[-1] THEN len(edges) - 1 ELSE len([x FOR x IN edges IF x <= v]) END AS bin FROM d JOIN e USING (feature_name)),
g AS (SELECT feature_name, bin, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM h WHERE bin BETWEEN 1 AND len(edges) - 1 GROUP BY ALL),
q AS (SELECT *, a / sum(a) OVER (PARTITION BY feature_name) AS pa, b / sum(b) OVER (PARTITION BY feature_name) AS pb FROM g),
r AS (SELECT feature_name, abs(sum((pb - pa) * ln(pb / pa))) AS psi FROM q GROUP BY feature_name)
SELECT feature_name, psi >= 0.1 AS drift_detected, CASE WHEN least(psi / 2, 1) < 0.1 THEN 'low' WHEN least(psi / 2, 1) < 0.25 THEN 'medium' WHEN least(psi / 2, 1) < 0.5 THEN 'high' ELSE 'critical' END AS severity FROM r""")
def input_drift_psi(spark, folder):
    made = drift.input_drift(*halves(spark, folder), ["value", "user_id"], method="psi")
    return made.select("feature_name", "drift_detected", "severity")


# -- predictions --------------------------------------------------------------------------------


def predicted_labels(spark, folder):
    """Labels beside a simple guess from the document: long texts are good, short ones are not."""
    guess = F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") > 200, F.col("doc_id").cast("int") % 2).otherwise(2)
    return table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", guess.alias("guess"))


GUESSES = """
WITH g AS (SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars > 200 THEN (doc_id % 2)::INTEGER ELSE 2 END AS p FROM labels JOIN documents USING (doc_id))
"""


@query("confusion_matrix", GUESSES + "SELECT y AS quality, p AS guess, count(*) AS n FROM g GROUP BY ALL")
def confusion_matrix(spark, folder):
    return models.confusion(predicted_labels(spark, folder), "quality", "guess")


@query("classification_metrics", GUESSES + """
, c AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y = k) AS s, count(*) FILTER (p = k) AS q FROM g, (VALUES (0), (1), (2)) v(k) GROUP BY k)
SELECT sum(s)::BIGINT AS samples, round(sum(tp) / sum(s), 8) AS accuracy, round(sum(CASE WHEN q = 0 THEN 0 ELSE tp / q END * s) / sum(s), 8) AS precision,
  round(sum(CASE WHEN s = 0 THEN 0 ELSE tp / s END * s) / sum(s), 8) AS recall, round(sum(CASE WHEN s + q = 0 THEN 0 ELSE 2 * tp / (s + q) END * s) / sum(s), 8) AS f1 FROM c""")
def classification_metrics(spark, folder):
    made = models.classification_metrics(predicted_labels(spark, folder), "quality", "guess")
    return rounded(made, 8, "accuracy", "precision", "recall", "f1")


@query("regression_metrics", """
WITH g AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem)
SELECT count(*) AS samples, round(avg((y - p) ** 2) / 1e9, 6) AS mse_scaled, round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2 FROM g""")
def regression_metrics(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 2000).alias("guess"))
    made = models.regression_metrics(lines, "l_extendedprice", "guess").withColumn("mse_scaled", F.col("mse") / 1e9).drop("mse")
    return rounded(rounded(rounded(made, 6, "mse_scaled"), 4, "mae"), 8, "r2")


@query("performance_degradation", HALVES + """
, m AS (SELECT event_type AS metric_name, (SELECT avg(value) FROM base b WHERE b.event_type = e.event_type) AS baseline_value, (SELECT avg(value) FROM cur c WHERE c.event_type = e.event_type) AS current_value FROM (SELECT DISTINCT event_type FROM events) e),
d AS (SELECT *, (current_value - baseline_value) / baseline_value * 100 AS change FROM m)
SELECT metric_name, round(change, 6) AS change_percentage, abs(change) > 5 AS performance_degraded, CASE WHEN abs(change) < 5 THEN 'low' WHEN abs(change) < 15 THEN 'medium' WHEN abs(change) < 30 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN change < 0 THEN 'down' WHEN change > 0 THEN 'up' ELSE 'same' END AS direction FROM d""")
def performance_degradation(spark, folder):
    is_base = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    metrics = table(spark, folder, "events").groupBy(F.col("event_type").alias("metric_name")).agg(
        F.avg(F.when(is_base, F.col("value"))).alias("baseline_value"), F.avg(F.when(~is_base, F.col("value"))).alias("current_value")
    )
    made = models.degradation(metrics).select("metric_name", "change_percentage", "performance_degraded", "severity", "direction")
    return rounded(made, 6, "change_percentage")


def _models_of_users(spark, folder):
    """Each user's events as the statistics of one model."""
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("model")).agg(
        F.avg(F.when(F.col("ts") >= middle, F.col("value"))).alias("current_performance"),
        F.avg(F.when(F.col("ts") < middle, F.col("value"))).alias("baseline_performance"),
        F.count_if(F.col("event_type") == "error").alias("drifted_features"),
        F.count(F.lit(1)).alias("checked_features"),
        (F.count(F.lit(1)) * 2).alias("recent_rows"),
        F.min("ts").alias("model_created_at"),
        (F.count(F.lit(1)) * 150).alias("new_rows"),
    )


TRIGGERS = [
    ("scheduled", "daily", None), ("scheduled", "weekly", None), ("scheduled", "monthly", None),
    ("performance_degradation", None, 0.1), ("data_drift", None, None), ("model_staleness", None, 29.0), ("data_volume", None, None),
]


@query("retraining_triggers", HALVES + """
, s AS (SELECT user_id AS model, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS c, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS b, count(*) FILTER (event_type = 'error') AS d, count(*) AS n, min(ts) AS made, max(ts) AS last FROM events GROUP BY ALL),
t(trigger_type, schedule, threshold) AS (VALUES ('scheduled', 'daily', NULL), ('scheduled', 'weekly', NULL), ('scheduled', 'monthly', NULL), ('performance_degradation', NULL, 0.1), ('data_drift', NULL, NULL), ('model_staleness', NULL, 29.0), ('data_volume', NULL, NULL)),
x AS (SELECT *, CASE WHEN model % 4 <> 0 THEN last - to_days((model % 4 * 3)::INTEGER) END AS lt FROM s, t)
SELECT model, trigger_type, schedule, coalesce(NOT (lt IS NOT NULL AND TIMESTAMP '2024-01-31' - lt < INTERVAL 24 HOUR) AND CASE trigger_type WHEN 'scheduled' THEN lt IS NULL OR
    CASE schedule WHEN 'daily' THEN DATE '2024-01-31' > lt::DATE WHEN 'weekly' THEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lt) >= 7 * 86400000000 ELSE epoch_us(TIMESTAMP '2024-01-31') - epoch_us(lt) >= 30 * 86400000000 END
  WHEN 'performance_degradation' THEN (b - c) / b > 0.1 WHEN 'data_drift' THEN n * 2 >= 100 AND d / n > 0.2 WHEN 'model_staleness' THEN (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(made)) // 86400000000 > 29 ELSE n * 150 >= 10000 END, false) AS fires FROM x""")
def retraining_triggers(spark, folder):
    last = table(spark, folder, "events").groupBy(F.col("user_id").alias("model")).agg(F.max("ts").alias("last"))
    rules = F.array(
        *[
            F.struct(F.lit(kind).alias("trigger_type"), F.lit(schedule).cast("string").alias("schedule"), F.lit(limit).cast("double").alias("threshold"))
            for kind, schedule, limit in TRIGGERS
        ]
    )
    moment = F.when(F.col("model") % 4 != 0, F.col("last") - F.make_dt_interval(days=(F.col("model") % 4 * 3).cast("int")))
    triggers = last.select("model", moment.alias("last_triggered"), F.explode(rules).alias("t")).select("model", "last_triggered", "t.*")
    made = models.retraining_due(triggers, _models_of_users(spark, folder), "2024-01-31")
    return made.select("model", "trigger_type", "schedule", "fires")


WIDTH = 64
SCORERS = {
    "even": models.LinearModel([((i * 7) % 11 - 5) / 10 for i in range(WIDTH)], 0.25),
    "odd": models.LogisticModel([((i * 5) % 13 - 6) / 10 for i in range(WIDTH)], -0.1),
}


@query("batch_scoring", """
WITH v AS (SELECT vec_id, label % 3 AS m, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, m, list_sum([e[i + 1] * (((i * 7) % 11 - 5) / 10) FOR i IN range(0, 64)]) + 0.25 AS a, list_sum([e[i + 1] * (((i * 5) % 13 - 6) / 10) FOR i IN range(0, 64)]) - 0.1 AS b FROM v)
SELECT vec_id, CASE m WHEN 0 THEN 'even' WHEN 1 THEN 'odd' ELSE 'unknown' END AS model,
  CASE WHEN vec_id % 20 = 3 THEN NULL WHEN m = 0 THEN round(a, 6) WHEN m = 1 THEN CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END END AS prediction,
  CASE WHEN m = 1 AND vec_id % 20 <> 3 THEN round(greatest(1 / (1 + exp(-b)), 1 - 1 / (1 + exp(-b))), 6) END AS confidence,
  CASE WHEN m = 2 THEN 'model_not_found' WHEN vec_id % 20 = 3 THEN 'error' ELSE 'success' END AS status FROM s""")
def batch_scoring(spark, folder):
    model = F.when(F.col("label") % 3 == 0, "even").when(F.col("label") % 3 == 1, "odd").otherwise("unknown")
    """One vector in twenty is short or missing, which is an error of its own row."""
    vector = F.col("embedding").cast("array<double>")
    broken = F.when(F.col("vec_id") % 40 == 3, F.slice(vector, 1, 9))
    features = F.when(F.col("vec_id") % 20 == 3, broken).otherwise(vector).alias("features")
    rows = table(spark, folder, "embeddings").select("vec_id", features, model.alias("model"))
    scored = models.score(rows, "vec_id", "features", "model", SCORERS)
    return rounded(scored.withColumn("status", F.substring_index("status", ":", 1)), 6, "prediction", "confidence")

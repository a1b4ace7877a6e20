"""Experiment queries: customers are the users, events their behaviour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import comparison, experiments
from quillon.operators.experiments import Flag, TargetRule
from quillon.plans.registry import query, rounded, table
from quillon.session import checkpointed

VARIANTS = [("control", 40.0), ("green", 30.0), ("blue", 20.0)]
NAMES = [name for name, _ in VARIANTS]


def md5_mod_sql(text: str, modulus: int) -> str:
    rest = "0"
    for start in (1, 9, 17, 25):
        rest = f"(({rest} * {(1 << 32) % modulus} + ('0x' || substr(md5({text}), {start}, 8))::BIGINT) % {modulus})"
    return rest


def pick_sql(point: str, shares, operator: str, otherwise: str = "NULL") -> str:
    running, cases = 0.0, []
    for name, share in shares:
        running += share
        cases.append(f"WHEN {point} {operator} {running} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


ASSIGNED = f"""
WITH u AS (SELECT c_custkey AS user_id, c_mktsegment, c_acctbal, {md5_mod_sql("'checkout:' || c_custkey", 10000)} / 100.0 AS point FROM customer),
a AS (SELECT user_id, c_mktsegment, c_acctbal, {pick_sql('point', VARIANTS, '<=')} AS variant FROM u)
"""


def users(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")


def assigned(spark, folder):
    return experiments.assign(users(spark, folder), "user_id", "checkout", VARIANTS)


@query("variant_assignment", ASSIGNED + "SELECT user_id, variant FROM a WHERE variant IS NOT NULL")
def variant_assignment(spark, folder):
    return assigned(spark, folder).select("user_id", "variant")


@query("variant_eligibility", ASSIGNED + """
SELECT user_id, variant FROM a WHERE variant IS NOT NULL AND c_mktsegment = 'BUILDING' AND user_id <> 10""")
def variant_eligibility(spark, folder):
    made = experiments.assign(
        users(spark, folder), "user_id", "checkout", VARIANTS,
        audience={"c_mktsegment": "BUILDING", "country": "unknown"}, exclusions={"user_id": 10},
    )
    return made.select("user_id", "variant")


@query("variant_sticky", ASSIGNED + """
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'blue' ELSE variant END AS variant FROM a WHERE user_id % 5 = 0 OR variant IS NOT NULL""")
def variant_sticky(spark, folder):
    existing = users(spark, folder).filter(F.col("user_id") % 5 == 0).select("user_id", F.lit("blue").alias("variant"))
    return experiments.assign(users(spark, folder), "user_id", "checkout", VARIANTS, existing).select("user_id", "variant")


def tracked(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("event_value")
    )
    return experiments.attribute(events, assigned(spark, folder), "user_id")


TRACKED = ASSIGNED + """
, t AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS event_value, variant FROM events JOIN a USING (user_id) WHERE variant IS NOT NULL),
v AS (SELECT variant, coalesce(event_value, CASE WHEN event_type = 'purchase' THEN 1.0 END)::DOUBLE AS value FROM t WHERE event_value IS NOT NULL OR event_type = 'purchase')
"""


@query("event_attribution", TRACKED + "SELECT user_id, event_id, event_type, event_value, variant FROM t")
def event_attribution(spark, folder):
    return tracked(spark, folder)


def stats(spark, folder):
    return experiments.variant_stats(experiments.metric_values(tracked(spark, folder), "purchase"), NAMES)


def moments(spark, folder):
    """The same without the median."""
    values = experiments.metric_values(tracked(spark, folder), "purchase")
    return experiments.variant_stats(values, NAMES, with_median=False)


@query("variant_stats", TRACKED + """
SELECT variant, count(*) AS sample_size, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS std, round(var_samp(value), 4) AS var, round(median(value), 6) AS median
FROM v GROUP BY variant""")
def variant_stats(spark, folder):
    return rounded(rounded(rounded(stats(spark, folder), 9, "mean"), 6, "std", "median"), 4, "var")


def with_large_purchases(spark, folder):
    """All events; purchases over 120 are a type of their own, as nearly every user has some purchase."""
    large = (F.col("event_type") == "purchase") & (F.col("value") > 120)
    return table(spark, folder, "events").withColumn("event_type", F.when(large, "large purchase").otherwise(F.col("event_type")))


@query("user_conversions", ASSIGNED + """
SELECT variant, count(*) AS users, sum(CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 120) THEN 1 ELSE 0 END)::BIGINT AS converted
FROM a WHERE variant IS NOT NULL GROUP BY variant""")
def user_conversions(spark, folder):
    made = experiments.user_conversions(assigned(spark, folder), with_large_purchases(spark, folder), "user_id", "large purchase")
    return made.groupBy("variant").agg(F.count(F.lit(1)).alias("users"), F.sum("value").cast("long").alias("converted"))


def tests(spark, folder):
    return comparison.t_test(experiments.variant_pairs(moments(spark, folder), NAMES))


def measured(spark, folder):
    """Variant statistics and their tests. The few rows of statistics are written once, so the
    queries that need both do not scan the events again."""
    rows = checkpointed(moments(spark, folder))
    return rows, comparison.t_test(experiments.variant_pairs(rows, NAMES))


PAIRS = TRACKED + """
, s AS (SELECT variant, count(*) AS n, avg(value) AS m, var_samp(value) AS v, list_position(['control', 'green', 'blue'], variant) AS i FROM v GROUP BY variant),
p AS (SELECT x.variant AS variant_a, y.variant AS variant_b, x.n AS n_a, y.n AS n_b, x.m AS m_a, y.m AS m_b, x.v AS v_a, y.v AS v_b,
  sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS pooled FROM s x JOIN s y ON x.i < y.i)
"""


def student_p_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over the density from 0 to t, in 400 steps."""
    density = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - ln({df} * pi()) / 2 - ({df} + 1) / 2 * ln(1 + (abs({t}) * k / 400.0::DOUBLE) ** 2 / {df}))"
    weight = "CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(1 - 2 * abs({t}) / 1200 * list_sum([{weight} * {density} FOR k IN range(0, 401)]))"


def normal_cdf_sql(z: str) -> str:
    """Normal distribution function by its series around 0; the odd factorials are gamma functions."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + ln(pi()) / 2 - ({z}) ** 2 / 2)"
    return f"(0.5 + sign({z}) / sqrt(2 * pi()) * list_sum([{term} FOR k IN range(0, 300)]))"


def student_point_sql(df: str, z: float = 1.959963984540054) -> str:
    """The 97.5 % point of Student's t by its expansion around the normal point, for many degrees of freedom."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    terms.append((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z!r}::DOUBLE + " + " + ".join(f"{t!r}::DOUBLE / ({df}) ** {k + 1}" for k, t in enumerate(terms)) + ")"


def chi_square_tail_sql(x: str, df: str) -> str:
    """Upper tail of chi-square: one less the series of the lower incomplete gamma function."""
    term = f"exp(({df} / 2 + k) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2 + k + 1))"
    return f"(1 - list_sum([{term} FOR k IN range(0, 3000)]))"


REACH_SQL = student_point_sql("{df}") + " * sqrt(v_a / n_a + v_b / n_b)"
INTERVAL_SQL = "round(m_b - m_a - {reach}, 6) AS ci_lower, round(m_b - m_a + {reach}, 6) AS ci_upper"


@query("variant_t_tests", PAIRS + """
SELECT variant_a, variant_b, n_a, n_b, round((m_a - m_b) / (pooled * sqrt(1 / n_a + 1 / n_b)), 6) AS statistic, (n_a + n_b - 2)::DOUBLE AS degrees_of_freedom,
  round((m_b - m_a) / pooled, 6) AS cohens_d, round((m_b - m_a) / pooled * (1 - 3 / (4 * (n_a + n_b) - 9)), 6) AS hedges_g,
  """ + INTERVAL_SQL.format(reach=REACH_SQL.format(df="(n_a + n_b - 2)")) + """,
  round(""" + student_p_sql("((m_a - m_b) / (pooled * sqrt(1 / n_a + 1 / n_b)))", "(n_a + n_b - 2)") + """, 7) AS p_value FROM p""")
def variant_t_tests(spark, folder):
    columns = ["variant_a", "variant_b", "n_a", "n_b", "statistic", "degrees_of_freedom", "cohens_d", "hedges_g", "ci_lower", "ci_upper", "p_value"]
    made = tests(spark, folder).select(*columns)
    return rounded(rounded(made, 6, "statistic", "cohens_d", "hedges_g", "ci_lower", "ci_upper"), 7, "p_value")


WELCH_DF = "((v_a / n_a + v_b / n_b) ** 2 / ((v_a / n_a) ** 2 / (n_a - 1) + (v_b / n_b) ** 2 / (n_b - 1)))"


@query("variant_welch_tests", PAIRS + """
SELECT variant_a, variant_b, round((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b), 6) AS statistic,
  round(""" + WELCH_DF + """, 4) AS degrees_of_freedom, """ + INTERVAL_SQL.format(reach=REACH_SQL.format(df=WELCH_DF)) + """,
  round(""" + student_p_sql("((m_a - m_b) / sqrt(v_a / n_a + v_b / n_b))", WELCH_DF) + """, 7) AS p_value FROM p""")
def variant_welch_tests(spark, folder):
    pairs = experiments.variant_pairs(moments(spark, folder), NAMES)
    made = comparison.t_test(pairs, equal_var=False).select("variant_a", "variant_b", "statistic", "degrees_of_freedom", "ci_lower", "ci_upper", "p_value")
    return rounded(rounded(rounded(made, 6, "statistic", "ci_lower", "ci_upper"), 4, "degrees_of_freedom"), 7, "p_value")


@query("variant_tests_corrected", PAIRS + """
, r AS (SELECT variant_a, variant_b, m_a, m_b, v_a, v_b, n_a, n_b, """ + student_p_sql("((m_a - m_b) / (pooled * sqrt(1 / n_a + 1 / n_b)))", "(n_a + n_b - 2)") + """ AS p FROM p),
i AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM r),
c AS (SELECT *, least(min(p * m / i) OVER (ORDER BY i DESC), 1.0) AS corrected FROM i)
SELECT variant_a, variant_b, round(p, 7) AS p_value, round(corrected, 6) AS corrected_p_value, corrected <= 0.05 AS reject_null,
  """ + INTERVAL_SQL.format(reach=REACH_SQL.format(df="(n_a + n_b - 2)")) + """ FROM c""")
def variant_tests_corrected(spark, folder):
    family = tests(spark, folder).withColumn("family", F.lit("checkout"))
    made = comparison.corrected_p(family, "family").select("variant_a", "variant_b", "p_value", "corrected_p_value", "reject_null", "ci_lower", "ci_upper")
    return rounded(rounded(made, 7, "p_value"), 6, "corrected_p_value", "ci_lower", "ci_upper")


@query("rank_sum_test", """
WITH g AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')),
x AS (SELECT v, count(*) AS n, count(*) FILTER (g = 'F') AS a, count(*) FILTER (g = 'O') AS b FROM g GROUP BY v),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM x),
s AS (SELECT sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * rank) AS ra, sum(n::DOUBLE ** 3 - n) AS ties FROM r),
z AS (SELECT *, (greatest(ra - n_a * (n_a + 1) / 2, n_a * n_b - (ra - n_a * (n_a + 1) / 2)) - n_a * n_b / 2 - 0.5)
    / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z FROM s)
SELECT n_a, n_b, (ra - n_a * (n_a + 1) / 2)::DOUBLE AS u_statistic, round(1 - 2 * (ra - n_a * (n_a + 1) / 2) / (n_a * n_b), 8) AS effect_size,
  round(z, 6) AS z, round(2 * (1 - """ + normal_cdf_sql("greatest(z, 1e-9)") + """), 7) AS p_value FROM z""")
def rank_sum_test(spark, folder):
    rows = table(spark, folder, "orders").withColumn("v", F.col("o_totalprice"))
    made = comparison.mann_whitney(rows, "o_orderstatus", "v", "F", "O")
    made = made.select("n_a", "n_b", "u_statistic", "effect_size", "z", "p_value")
    return rounded(rounded(rounded(made, 8, "effect_size"), 6, "z"), 7, "p_value")


@query("rank_sum_exact", """
WITH g AS (SELECT n_nationkey AS k, n_regionkey = 0 AS own, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY v) AS rank, count(*) OVER () AS n FROM g),
s AS (SELECT count(*) FILTER (own) AS n_a, count(*) FILTER (NOT own) AS n_b, sum(rank) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2 AS u FROM r),
w AS (SELECT a.rank + b.rank + c.rank + d.rank + e.rank - 15 AS u FROM r a JOIN r b ON a.rank < b.rank JOIN r c ON b.rank < c.rank JOIN r d ON c.rank < d.rank JOIN r e ON d.rank < e.rank)
SELECT n_a, n_b, u::DOUBLE AS u_statistic, round(least(1, 2 * (SELECT count(*) FILTER (w.u <= least(s.u, n_a * n_b - s.u)) / count(*) FROM w)), 9) AS p_value FROM s""")
def rank_sum_exact(spark, folder):
    """Mean balances of the nations of one region against all others: five against twenty, all orders counted."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 0).cast("string").alias("own"))
    means = table(spark, folder, "customer").join(nations, "c_nationkey").groupBy("c_nationkey", "own").agg(F.avg("c_acctbal").alias("v"))
    return rounded(comparison.mann_whitney(means, "own", "v", "true", "false").select("n_a", "n_b", "u_statistic", "p_value"), 9, "p_value")


CONVERTED = ASSIGNED + """
, h AS (SELECT variant, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 120) AS hit FROM a WHERE variant IS NOT NULL),
c AS (SELECT count(*) FILTER (variant = 'control') AS ta, count(*) FILTER (variant = 'control' AND hit) AS sa, count(*) FILTER (variant = 'green') AS tb, count(*) FILTER (variant = 'green' AND hit) AS sb FROM h)
"""


@query("proportion_test", CONVERTED + """
SELECT sa AS successes_a, ta AS trials_a, sb AS successes_b, tb AS trials_b,
  round((sa / ta - sb / tb) / sqrt((sa + sb) / (ta + tb) * (1 - (sa + sb) / (ta + tb)) * (1 / ta + 1 / tb)), 6) AS statistic, round(sb / tb - sa / ta, 8) AS effect_size,
  round(sb / tb - sa / ta - 1.959963984540054 * sqrt((sa + sb) / (ta + tb) * (1 - (sa + sb) / (ta + tb)) * (1 / ta + 1 / tb)), 8) AS ci_lower,
  round(sb / tb - sa / ta + 1.959963984540054 * sqrt((sa + sb) / (ta + tb) * (1 - (sa + sb) / (ta + tb)) * (1 / ta + 1 / tb)), 8) AS ci_upper,
  round(2 * (1 - """ + normal_cdf_sql("abs(z)") + """), 7) AS p_value FROM (SELECT *, (sa / ta - sb / tb) / sqrt((sa + sb) / (ta + tb) * (1 - (sa + sb) / (ta + tb)) * (1 / ta + 1 / tb)) AS z FROM c)""")
def proportion_test(spark, folder):
    made = experiments.user_conversions(assigned(spark, folder), with_large_purchases(spark, folder), "user_id", "large purchase")
    side = lambda name: F.col("variant") == name
    counts = made.agg(
        F.count_if(side("control") & (F.col("value") > 0)).alias("successes_a"),
        F.count_if(side("control")).alias("trials_a"),
        F.count_if(side("green") & (F.col("value") > 0)).alias("successes_b"),
        F.count_if(side("green")).alias("trials_b"),
    )
    result = comparison.proportion_test(counts).drop("is_significant")
    return rounded(rounded(rounded(result, 6, "statistic"), 8, "effect_size", "ci_lower", "ci_upper"), 7, "p_value")


@query("chi_square_test", """
WITH c AS (SELECT p_brand, p_type, count(*) AS o FROM part GROUP BY ALL), n AS (SELECT sum(o) AS n FROM c),
r AS (SELECT p_brand, sum(o) AS r FROM c GROUP BY ALL), k AS (SELECT p_type, sum(o) AS c FROM c GROUP BY ALL),
x AS (SELECT r * k.c / n AS e, coalesce(o, 0) AS o, n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (p_brand, p_type)),
y AS (SELECT max(n)::DOUBLE AS n, sum((o - e) ** 2 / e) AS x, (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1))::DOUBLE AS df,
  sqrt(sum((o - e) ** 2 / e) / (max(n) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))) AS cramers_v FROM x)
SELECT n, round(x, 6) AS statistic, df AS degrees_of_freedom, round(cramers_v, 8) AS cramers_v, round(""" + chi_square_tail_sql("x", "df") + """, 7) AS p_value FROM y""")
def chi_square_test(spark, folder):
    made = comparison.chi_square(table(spark, folder, "part"), "p_brand", "p_type").select("n", "statistic", "degrees_of_freedom", "cramers_v", "p_value")
    return rounded(rounded(rounded(made, 6, "statistic"), 8, "cramers_v"), 7, "p_value")


@query("chi_square_two_by_two", """
WITH c AS (SELECT quality, toxic, count(*) AS o FROM labels GROUP BY ALL), n AS (SELECT sum(o) AS n FROM c),
r AS (SELECT quality, sum(o) AS r FROM c GROUP BY ALL), k AS (SELECT toxic, sum(o) AS c FROM c GROUP BY ALL),
x AS (SELECT r * k.c / n AS e, coalesce(o, 0) AS o, n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c USING (quality, toxic)),
y AS (SELECT max(n)::DOUBLE AS n, sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) AS x FROM x)
SELECT n, round(x, 6) AS statistic, 1.0::DOUBLE AS degrees_of_freedom, round(CASE WHEN x > 0 THEN """ + chi_square_tail_sql("x", "1.0::DOUBLE") + """ ELSE 1 END, 7) AS p_value FROM y""")
def chi_square_two_by_two(spark, folder):
    made = comparison.chi_square(table(spark, folder, "labels"), "quality", "toxic").select("n", "statistic", "degrees_of_freedom", "p_value")
    return rounded(rounded(made, 6, "statistic"), 7, "p_value")


SEQUENTIAL = """
WITH g AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS g, value FROM events WHERE event_id < 2 * (SELECT count(*) // 2 FROM events)),
s AS (SELECT count(*) FILTER (g = 'a') AS n, avg(value) FILTER (g = 'a') AS ma, avg(value) FILTER (g = 'b') AS mb, var_samp(value) FILTER (g = 'a') AS va, var_samp(value) FILTER (g = 'b') AS vb FROM g)
"""


def _two_groups(spark, folder):
    events = table(spark, folder, "events").withColumn("g", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return comparison.two_group_moments(events, "g", "value", "a", "b")


@query("sequential_test", SEQUENTIAL + """
SELECT n AS sample_size, n * 0.125 / 2 AS information, round((mb - ma) / sqrt((va + vb) / n) * sqrt(n * 0.125 / 2), 6) AS test_statistic,
  round(ln(0.8 / 0.05) / (0.5 / sqrt(2)), 8) AS upper_boundary, round(ln(0.2 / 0.95) / (0.5 / sqrt(2)), 8) AS lower_boundary,
  CASE WHEN (mb - ma) / sqrt((va + vb) / n) * sqrt(n * 0.125 / 2) >= ln(0.8 / 0.05) / (0.5 / sqrt(2)) THEN 'reject_h0'
    WHEN (mb - ma) / sqrt((va + vb) / n) * sqrt(n * 0.125 / 2) <= ln(0.2 / 0.95) / (0.5 / sqrt(2)) THEN 'accept_h0' ELSE 'continue' END AS decision FROM s""")
def sequential_test(spark, folder):
    made = comparison.sequential_test(_two_groups(spark, folder))
    return rounded(rounded(made, 6, "test_statistic", "information"), 8, "upper_boundary", "lower_boundary")


def _nodes_sql(side: str) -> str:
    """Weights, means and variances of one side's posterior at 41 values of its unknown deviation."""
    log = f"-(n - 1) * ln(s) - q / (2 * s * s) - s * s / 2 - ln(400 + s * s / n) / 2 - (m - 30) ** 2 / (2 * (400 + s * s / n))"
    return f"""
{side}0 AS (SELECT n::DOUBLE AS n, m{side} AS m, (n - 1) * v{side} AS q FROM s),
{side}1 AS (SELECT *, sqrt((sqrt(n * n + 4 * q) - n) / 2) AS peak FROM {side}0),
{side}2 AS (SELECT *, peak + k * 7.5::DOUBLE / 20 / sqrt(3 * q / peak ** 4 - n / peak ** 2 + 1) AS s FROM {side}1, range(-20, 21) t(k)),
{side}3 AS (SELECT *, {log} AS log FROM {side}2 WHERE s > 0),
{side} AS (SELECT exp(log - max(log) OVER ()) / sum(exp(log - (SELECT max(log) FROM {side}3))) OVER () AS w, 1 / (1 / 400.0::DOUBLE + n / (s * s)) AS v,
  1 / (1 / 400.0::DOUBLE + n / (s * s)) * (30 / 400.0::DOUBLE + m * n / (s * s)) AS c FROM {side}3)"""


@query("bayesian_comparison", SEQUENTIAL.replace("WITH g", "WITH RECURSIVE g") + f""", {_nodes_sql("a")}, {_nodes_sql("b")},
d AS (SELECT a.w * b.w AS w, b.c - a.c AS d, sqrt(a.v + b.v) AS s FROM a, b),
q AS (SELECT sum(w * {normal_cdf_sql("d / s")}) AS better, sum(w * ({normal_cdf_sql("(0.5 - d) / s")} - {normal_cdf_sql("(-0.5 - d) / s")})) AS rope,
  sum(w * (d * {normal_cdf_sql("d / s")} + s * exp(0 - (d / s) ** 2 / 2) / sqrt(2 * pi()))) AS loss, sum(w * d) AS mean, max(s) AS wide FROM d),
i AS (SELECT 0 AS step, p, mean - 8 * wide AS low, mean + 8 * wide AS high FROM q, (VALUES (0.025::DOUBLE), (0.975)) t(p)
  UNION ALL SELECT step + 1, p, CASE WHEN below < p THEN (low + high) / 2 ELSE low END, CASE WHEN below < p THEN high ELSE (low + high) / 2 END
  FROM (SELECT *, (SELECT sum(w * {normal_cdf_sql("((low + high) / 2 - d) / s")}) FROM d) AS below FROM i) WHERE step < 40),
c AS (SELECT max(low) FILTER (p < 0.5) AS ci_lower, max(low) FILTER (p > 0.5) AS ci_upper FROM i WHERE step = 40)
SELECT round(better, 7) AS probability_b_better, round(1 - better, 7) AS probability_a_better, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper,
  round(loss, 6) AS expected_loss_a, round(loss - mean, 6) AS expected_loss_b, round(rope, 7) AS rope_probability FROM q, c""")
def bayesian_comparison(spark, folder):
    made = comparison.bayesian(_two_groups(spark, folder), prior_mean=30.0, prior_std=20.0, rope=(-0.5, 0.5))
    chances = ["probability_a_better", "probability_b_better", "rope_probability"]
    sizes = ["ci_lower", "ci_upper", "expected_loss_a", "expected_loss_b"]
    return rounded(rounded(made.select(*chances, *sizes), 7, *chances), 6, *sizes)


P_VALUES = "WITH t AS (SELECT p_brand AS family, p_partkey AS test, ((p_partkey * 7919) % 1009) / 20000.0 AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i FROM t)"


def _correction(method):
    def run(spark, folder):
        rows = table(spark, folder, "part").select(
            F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), ((F.col("p_partkey") * 7919) % 1009 / 20000.0).alias("p_value")
        )
        made = comparison.corrected_p(rows, "family", method).select("family", "test", "corrected_p_value")
        return rounded(made, 12, "corrected_p_value")

    return run


for _method, _sql in {
    "bonferroni": "least(p * m, 1.0)",
    "sidak": "1 - (1 - p) ** m",
    "holm": "least(max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY i), 1.0)",
    "benjamini_hochberg": "least(min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC), 1.0)",
    "benjamini_yekutieli": "least(min(p * m / i * list_sum([1.0::DOUBLE / k FOR k IN range(1, m + 1)])) OVER (PARTITION BY family ORDER BY i DESC), 1.0)",
}.items():
    query(f"correction_{_method}", f"{P_VALUES} SELECT family, test, round(({_sql})::DOUBLE, 12) AS corrected_p_value FROM r")(_correction(_method))


@query("experiment_stopping_samples", TRACKED + """
, n AS (SELECT variant, count(*) AS n FROM v GROUP BY variant), k AS (SELECT min(variant) AS low FROM n WHERE n < (SELECT max(n) FROM n))
SELECT false AS should_stop, low IS NOT NULL AS names_variant FROM k""")
def experiment_stopping_samples(spark, folder):
    """Every variant but the largest has fewer samples than asked for."""
    rows, pairs = measured(spark, folder)
    most = rows.agg(F.max("sample_size")).first()[0]
    made = experiments.stopping(rows, pairs, most, 30, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9))
    low = rows.filter(F.col("sample_size") < most).agg(F.min("variant")).scalar()
    return made.select("should_stop", F.contains("reason", low).alias("names_variant"))


@query("experiment_stopping", ASSIGNED + "SELECT true AS should_stop, 'Maximum duration reached: 30 days' AS reason FROM a LIMIT 1")
def experiment_stopping(spark, folder):
    return experiments.stopping(
        *measured(spark, folder), 10, 30, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    )


@query("experiment_winner", PAIRS + """
, pv AS (SELECT min(""" + student_p_sql("((m_a - m_b) / (pooled * sqrt(1 / n_a + 1 / n_b)))", "(n_a + n_b - 2)") + """) AS least FROM p)
SELECT variant AS winner, round(1 - least, 6) AS confidence FROM s, pv ORDER BY m DESC LIMIT 1""")
def experiment_winner(spark, folder):
    return rounded(experiments.winner(*measured(spark, folder)), 6, "confidence")


FLAG = Flag(
    "new_home", default="old", current="new", percentage=25.0,
    rules=(TargetRule({"attr_c_mktsegment": "BUILDING"}, "builder", 50), TargetRule({"user_ids": [3, 5, 8], "missing": 1}, "listed", 200)),
    test_name="colours", test_variants={"r": "red", "g": "green"}, test_shares=(("r", 10.0), ("g", 15.0), ("unused", 5.0)),
)


@query("flag_values", f"""
WITH u AS (SELECT c_custkey AS user_id, c_mktsegment, {md5_mod_sql("'new_home:' || c_custkey || ':colours'", 10000)} / 100.0 AS t, {md5_mod_sql("'new_home:' || c_custkey", 10000)} / 100.0 AS p FROM customer)
SELECT user_id, CASE WHEN user_id IN (3, 5, 8) THEN 'listed' WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN t <= 10 THEN 'red' WHEN t <= 25 THEN 'green' WHEN p <= 25 THEN 'new' ELSE 'old' END AS value FROM u""")
def flag_values(spark, folder):
    rows = users(spark, folder)
    return rows.select("user_id", experiments.flag_value(rows, "user_id", FLAG).alias("value"))


SPLIT = [("stable", 60.0), ("candidate", 40.0)]


@query("traffic_split", f"""
SELECT user_id, count(*) AS events, {pick_sql(md5_mod_sql("'ranker:' || user_id", 100), SPLIT, '<', "'stable'")} AS variant FROM events GROUP BY user_id""")
def traffic_split(spark, folder):
    counted = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.withColumn("variant", experiments.traffic_variant(F.col("user_id"), "ranker", SPLIT, "stable"))


@query("traffic_gradual_rollout", f"""
SELECT user_id, {pick_sql(md5_mod_sql("'ranker:' || user_id", 100), [("stable", 90.0), ("candidate", 10.0)], '<', "'stable'")} AS variant FROM (SELECT DISTINCT user_id FROM events)""")
def traffic_gradual_rollout(spark, folder):
    shares = experiments.rollout_shares(SPLIT, "stable", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 6), 20)
    people = table(spark, folder, "events").select("user_id").distinct()
    return people.withColumn("variant", experiments.traffic_variant(F.col("user_id"), "ranker", shares, "stable"))


@query("traffic_audience", f"""
SELECT c_custkey AS user_id FROM customer WHERE {md5_mod_sql("c_custkey::VARCHAR", 100)} + 1 <= 35 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def traffic_audience(spark, folder):
    rows = users(spark, folder)
    kept = experiments.in_audience(F.col("user_id"), 35, F.array("c_mktsegment"), ["BUILDING", "MACHINERY"])
    return rows.filter(kept).select("user_id")


def run_metrics(spark, folder):
    """A metric per event type and day-of-month third: three runs."""
    return table(spark, folder, "events").groupBy(
        F.concat(F.lit("run"), F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))).alias("run_id"), F.col("event_type").alias("key")
    ).agg(F.max("value").alias("value"))


RUNS = "WITH m AS (SELECT 'run' || least((day(ts) - 1) // 10, 2) AS run_id, event_type AS key, max(value) AS value FROM events GROUP BY ALL)"


@query("run_matrix", RUNS + """
SELECT key, max(value) FILTER (run_id = 'run0') AS run0, max(value) FILTER (run_id = 'run1') AS run1, max(value) FILTER (run_id = 'run2') AS run2 FROM m GROUP BY key""")
def run_matrix(spark, folder):
    return experiments.run_matrix(run_metrics(spark, folder), ["run0", "run1", "run2"])


@query("run_parameters", """
WITH p AS (SELECT DISTINCT 'brand' || p_brand AS run_id, 'types' AS key, 'all' AS value FROM part UNION ALL SELECT 'brand' || p_brand, 'largest', CAST(max(p_size) AS VARCHAR) FROM part GROUP BY p_brand)
SELECT key, count(*) AS run_count, min(value) = max(value) AS is_common, CASE WHEN min(value) = max(value) THEN min(value) END AS common_value FROM p GROUP BY key""")
def run_parameters(spark, folder):
    brands = table(spark, folder, "part").groupBy("p_brand").agg(F.max("p_size").cast("string").alias("largest"))
    params = brands.select(
        F.concat(F.lit("brand"), "p_brand").alias("run_id"),
        F.explode(F.create_map(F.lit("types"), F.lit("all"), F.lit("largest"), F.col("largest"))).alias("key", "value"),
    )
    return experiments.parameter_agreement(params)


@query("version_comparison", """
WITH m AS (SELECT event_type AS metric, avg(value) FILTER (day(ts) <= 15) AS a, avg(value) FILTER (day(ts) > 15) AS b FROM events GROUP BY event_type)
SELECT 'ranker' AS model, metric, round(a, 6) AS version1_value, round(b, 6) AS version2_value, round(b - a, 6) AS difference, round((b - a) / a * 100, 6) AS percentage_change FROM m""")
def version_comparison(spark, folder):
    metrics = table(spark, folder, "events").groupBy(
        F.lit("ranker").alias("model"), F.when(F.dayofmonth("ts") <= 15, "1.0").otherwise("2.0").alias("version"), F.col("event_type").alias("metric")
    ).agg(F.avg("value").alias("value"))
    return rounded(experiments.compare_versions(metrics, "1.0", "2.0"), 6, "version1_value", "version2_value", "difference", "percentage_change")


@query("stale_failed_runs", "SELECT event_id AS run_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def stale_failed_runs(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"), F.col("ts").alias("start_time")
    )
    return experiments.stale_failures(runs, "2024-01-31", 7).select("run_id")

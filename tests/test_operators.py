"""Small literal fixtures with results worked out by hand, and the cases where behaviour is easy to get wrong."""

import datetime as dt
import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from quillon.functions import tails
from quillon.functions.ordering import quantiles, indexed_quantile
from quillon.operators import alerts, comparison, drift, experiments, features, federation, lineage, models, olap, profiling, quality, runlog
from quillon.operators.events import check_events, split_events
from quillon.operators.ingestion import ingest
from quillon.operators.olap import Cube, CubeQuery, CubeSchema, Dimension, Level, Measure
from quillon.operators.windows import Agg, Everything, Session, Sliding, Tumbling, window_aggregate
from quillon.plans.catalogue import QUERIES
from quillon.sources import catalog, files


def stamps(df, *names):
    for name in names:
        df = df.withColumn(name, F.to_timestamp(name))
    return df


# -- cubes --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sales(spark):
    data = [("eu", "a", 10.0, 1), ("eu", "b", 20.0, 2), ("us", "a", 30.0, 3), ("us", "b", 30.0, 1), (None, "a", 5.0, 1)]
    schema = CubeSchema(
        "sales",
        (Dimension("region", "region"), Dimension("product", "product_name"), Dimension("place", "region", "hierarchical", (Level("zone", "region", 1), Level("item", "product_name", 2)))),
        (Measure("revenue", "price", "sum"), Measure("quantity", "quantity", "sum"), Measure("avg_price", "price", "avg")),
    )
    return Cube(spark.createDataFrame(data, "region string, product_name string, price double, quantity int"), schema)


def test_cube_unknown_names_raise(sales):
    for query in (CubeQuery(("nowhere",), ("revenue",)), CubeQuery((), ("profit",)), CubeQuery(("region",), (), {"nowhere": 1})):
        with pytest.raises(ValueError):
            sales.query(query)


def test_cube_empty_list_and_null_filter_give_no_rows(sales):
    assert rows(sales.query(CubeQuery(("region",), ("revenue",), {"region": []}))) == []
    assert rows(sales.query(CubeQuery(("region",), ("revenue",), {"region": None}))) == []


def test_cube_limit_zero_is_a_limit(sales):
    assert rows(sales.query(CubeQuery(("region",), ("revenue",), limit=0))) == []


def test_having_uses_the_measure_name(sales):
    assert rows(sales.query(CubeQuery(("region",), ("revenue",), having={"revenue": ">= 60"}))) == [("us", 60.0)]
    with pytest.raises(ValueError):
        olap.having_condition(F.lit(1), "; drop table x")


def test_top_n_breaks_ties_by_dimension(sales):
    step = olap.top_n("revenue", 2)
    got = sales.query(step(CubeQuery(("region", "product"), ())))
    assert [tuple(r) for r in got.collect()] == [("us", "a", 30.0), ("us", "b", 30.0)]
    assert "TakeOrderedAndProject" in plan_of(got)


def test_roll_up_removes_the_filter_too(sales):
    query = olap.roll_up("region")(CubeQuery(("region", "product"), ("revenue",), {"region": "eu"}))
    assert rows(sales.query(query)) == [("a", 45.0), ("b", 50.0)]


def test_drill_down_then_up(sales):
    down = olap.drill_down("place", "item")(CubeQuery((), ("quantity",)))
    assert sales.query(down).columns == ["zone", "item", "quantity"]
    assert sales.query(olap.drill_up("place", "zone")(down)).columns == ["zone", "quantity"]


def test_slice_filter_reaches_the_scan(spark, sf):
    cube = Cube(spark.read.parquet(f"{sf}/lineitem.parquet"), CubeSchema("l", (Dimension("flag", "l_returnflag"),), (Measure("q", "l_quantity", "sum"),)))
    plan = plan_of(cube.query(olap.slice_by("flag", "A")(CubeQuery(("flag",), ("q",)))))
    assert "EqualTo(l_returnflag,A)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_discovery(spark):
    df = spark.createDataFrame([], "customer_id int, width double, unit_avg float, name string, day date, amount decimal(9,2), flag boolean")
    schema = olap.discover_schema(df, "t")
    assert {d.name: d.kind for d in schema.dimensions} == {"customer_id": "numerical", "name": "categorical", "day": "temporal", "width": "numerical"}
    assert {m.name: m.aggregation for m in schema.measures} == {"unit_avg": "avg", "amount": "sum"}
    only_text = olap.discover_schema(spark.createDataFrame([], "name string"), "t")
    assert [(m.name, m.column) for m in only_text.measures] == [("record_count", "*")]
    with pytest.raises(ValueError):
        olap.discover_schema(spark.createDataFrame([], "amount double"), "t")


# -- federation ---------------------------------------------------------------------------------


def test_join_keeps_last_left_row_and_matches_nulls(spark):
    left = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "none", 3)], "k int, a string, i int")
    right = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3), (9, "w", 4)], "k int, b string, j int")
    got = federation.join_sources([left, right], ["k"], ["i", "j"])
    assert got.columns == ["k", "a", "i", "b", "j"]
    assert rows(got, "k", "a", "b") == sorted([(1, "new", "x"), (1, "new", "y"), (None, "none", "z")], key=repr)


def test_join_without_keys_in_a_source(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    b = spark.createDataFrame([("b",)], "y string")
    assert rows(federation.join_sources([a, b], ["k"], ["k", "y"])) == [(1, "a")]
    assert federation.join_sources([b, a], ["k"], ["y", "k"]).columns == ["y"]


def test_federation_reports_failures(spark):
    def broken():
        return spark.table("no_such_table")

    good = spark.createDataFrame([(1,)], "k int")
    result = federation.federate({"bad": broken, "good": lambda: good}, "join", None)
    assert list(result.errors) == ["bad"] and not result.success
    assert rows(result.combined) == [(1,)]
    assert federation.federate({"bad": broken}).combined is None


# -- windows ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def clicks(spark):
    data = [
        (1, "u", "2024-01-01 00:00:00", 1.0), (2, "u", "2024-01-01 00:00:59.999", None), (3, "u", "2024-01-01 00:01:00", 3.0),
        (4, "u", "2024-01-01 00:06:00", 5.0), (5, "u", "2024-01-01 00:11:00.001", 7.0), (6, None, "2024-01-01 00:00:30", 9.0),
    ]
    return stamps(spark.createDataFrame(data, "event_id int, user string, ts string, value double"), "ts")


def test_tumbling_is_half_open(clicks):
    got = window_aggregate(clicks, "user", Tumbling(60_000), [Agg("count"), Agg("sum", "value"), Agg("avg", "value"), Agg("min", "value"), Agg("first", "value")])
    first = [tuple(r)[3:] for r in got.filter("user = 'u'").orderBy("window_start").collect()]
    assert first == [(2, 1.0, 1.0, 1.0, 1.0), (1, 3.0, 3.0, 3.0, 3.0), (1, 5.0, 5.0, 5.0, 5.0), (1, 7.0, 7.0, 7.0, 7.0)]


def test_window_without_numbers(spark):
    df = stamps(spark.createDataFrame([(1, "u", "2024-01-01 00:00:00", None)], "event_id int, user string, ts string, value double"), "ts")
    aggs = [Agg(k, "value") for k in ("sum", "avg", "min", "max", "last", "distinct_count", "percentile")]
    assert tuple(window_aggregate(df, "user", Tumbling(1000), aggs).first())[3:] == (0.0, 0.0, None, None, None, 0, None)
    assert tuple(window_aggregate(df, "user", Everything(), aggs).first())[1:] == (0.0, 0.0, None, None, None, 0, None)


def test_session_gap_is_inclusive(clicks):
    got = window_aggregate(clicks, "user", Session(), [Agg("count"), Agg("last", "value")]).filter("user = 'u'").orderBy("window_start")
    assert [(r["window_start"].minute, r["window_end"].minute, r["count"], r["last_value"]) for r in got.collect()] == [(0, 11, 4, 5.0), (11, 16, 1, 7.0)]


@pytest.mark.parametrize("window,spark_window", [
    (Tumbling(3_600_000), lambda: F.window("ts", "1 hour")),
    (Sliding(7_200_000, 1_800_000), lambda: F.window("ts", "2 hours", "30 minutes")),
    (Sliding(6_000_000, 4_200_000), lambda: F.window("ts", "100 minutes", "70 minutes")),
    (Session(1_800_000), lambda: F.session_window("ts", "30 minutes")),
])
def test_slices_agree_with_spark_windows(spark, sf, window, spark_window):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = window_aggregate(events, "event_type", window, [Agg("count"), Agg("max", "value"), Agg("distinct_count", "user_id")])
    expected = events.groupBy("event_type", spark_window().alias("w")).agg(F.count("*"), F.max("value"), F.count_distinct("user_id"))
    assert rows(got) == rows(expected.select("event_type", "w.start", "w.end", "count(1)", "max(value)", F.col(expected.columns[-1])))


def test_percentile_in_sessions_against_brute_force(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = window_aggregate(events, "user_id", Session(86_400_000), [Agg("percentile", "value", 75, "p")])
    by_user = {}
    for r in events.orderBy("ts").collect():
        sessions = by_user.setdefault(r["user_id"], [])
        if not sessions or r["ts"] - sessions[-1][-1][0] > dt.timedelta(days=1):
            sessions.append([])
        sessions[-1].append((r["ts"], r["value"]))
    expected = []
    for user, sessions in by_user.items():
        for s in sessions:
            values = sorted(v for _, v in s)
            expected.append((user, s[0][0], values[min(int(len(values) * 75 / 100), len(values) - 1)]))
    assert rows(got, "user_id", "window_start", "p") == sorted(expected, key=repr)


# -- events -------------------------------------------------------------------------------------


def event(**changes):
    base = {"event_id": "1", "event_type": "metric", "event_name": "n", "source_service": "s", "payload": {"a": 1}}
    base.update(changes)
    return json.dumps({k: v for k, v in base.items() if v is not None})


@pytest.mark.parametrize("text,schema,errors", [
    (event(), "base_event", []),
    (event(timestamp=1704067200.5), "base_event", []),
    (event(timestamp="2024-01-01T10:00:00Z"), "base_event", []),
    (event(timestamp="1704067200"), "base_event", ["bad timestamp"]),
    (event(timestamp="soon"), "base_event", ["bad timestamp"]),
    (event(payload={}), "base_event", ["empty payload"]),
    (event(payload=None), "base_event", ["empty payload"]),
    (event(payload="text"), "base_event", ["empty payload"]),
    (event(event_type="other"), "base_event", ["unknown event_type"]),
    (event(event_name=None), "base_event", ["missing event_name"]),
    ("{nope", "base_event", ["not json"]),
    (event(event_type=None, user_id="u", session_id="s", action="a", payload={"page": 1}), "user_action", ["payload without element"]),
    (event(component="c", severity="warning"), "system_event", []),
    (event(component="c", severity="loud"), "system_event", ["unknown severity"]),
    (event(component="c"), "system_event", []),
    (event(model_name="m", model_version="1", confidence_score=1.01), "ml_prediction", ["confidence out of range"]),
    (event(model_name="m", model_version="1"), "ml_prediction", []),
    (event(metric_name="m", metric_type="Gauge", metric_value=1), "metric_event", []),
    (event(entity_type="order"), "business_event", ["missing entity_id"]),
])
def test_event_checks(spark, text, schema, errors):
    checked = check_events(spark.createDataFrame([(text,)], "value string"), schema_name=schema)
    assert checked.first()["errors"] == errors


def test_event_fields_and_split(spark):
    df = spark.createDataFrame([(event(timestamp=1704067200, component="c", severity="error"),), ("x",)], "value string")
    good, bad = split_events(check_events(df, schema_name="system_event"))
    row = good.first()
    assert (row["severity"], row["event_time"], row["payload"], row["source_version"]) == ("ERROR", dt.datetime(2024, 1, 1), '{"a":1}', "1.0.0")
    assert bad.count() == 1
    with pytest.raises(ValueError):
        check_events(df, schema_name="nope")


# -- quality and profiles -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "A", 20, 1.5, True), (2, "B", 30, 2.5, False), (3, "B", None, 3.5, True), (3, "B", None, 3.5, True), (5, None, 50, 9.5, True), (6, "C", 61, 2.0, None)]
    return spark.createDataFrame(data, "id long, name string, age long, score double, active boolean")


def test_unique_counts_nulls_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "v int")
    suite = [{"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "v"}}]
    assert [(r["success"], r["observed"]) for r in quality.run_suite(df, suite).collect()] == [(False, 1.0)]


def test_suite_is_one_pass(people):
    suite = quality.common_expectations(people.columns, None, ["name", "age"])
    plan = plan_of(quality.run_suite(people, suite))
    assert plan.count("Scan ExistingRDD") == 1


def test_suite_on_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    results = quality.run_suite(df, quality.common_expectations(["a"], ["a"]))
    assert [r["success"] for r in results.orderBy("check_no").collect()] == [True, False, True, True, True]
    assert quality.suite_summary(results, "t").first()["success_rate"] == 0.8
    assert quality.suite_summary(results.limit(0), "t").first()["success_rate"] == 0.0


def test_profile_of_people(people):
    table = profiling.table_profile(people).first()
    assert (table["duplicate_rows"], table["missing_cells"], table["row_count"]) == (1, 4, 6)
    columns = {r["column"]: r for r in profiling.column_profile(people).collect()}
    assert (columns["name"]["most_frequent_value"], columns["name"]["most_frequent_count"], columns["name"]["missing_count"]) == ("B", 3, 1)
    assert columns["active"]["unique_count"] == 2
    numbers = {r["column"]: r for r in profiling.numeric_profile(people, ["age", "score"]).collect()}
    ages = [20, 30, 50, 61]
    assert numbers["age"]["std"] == pytest.approx(statistics.stdev(ages))
    assert numbers["age"]["q1"] == 27.5 and numbers["age"]["median"] == 40.0
    mean = statistics.mean(ages)
    m2, m3 = (sum((a - mean) ** k for a in ages) / 4 for k in (2, 3))
    assert numbers["age"]["skewness"] == pytest.approx(m3 / m2**1.5 * math.sqrt(12) / 2)
    lengths = profiling.text_profile(people, ["name"]).first()
    assert (lengths["min_length"], lengths["avg_length"]) == (1, 1.0)


def test_profile_of_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert profiling.table_profile(empty).first()["duplicate_rows"] == 0
    assert profiling.column_profile(empty).count() == 0
    assert profiling.numeric_profile(empty, ["a"]).first()["median"] is None
    assert profiling.top_categories(empty).count() == 0


def test_long_values_come_back_whole(spark):
    long_text = "x" * 5000
    df = spark.createDataFrame([(long_text,), (long_text,), ("y",)], "t string")
    assert profiling.column_profile(df).first()["most_frequent_value"] == long_text
    assert [r["value"] for r in profiling.top_categories(df).orderBy("rank").collect()] == [long_text, "y"]


# -- alerts -------------------------------------------------------------------------------------


def test_success_rate_rule_reads_fractions_as_percent(spark):
    df = spark.createDataFrame([("good", 0.96, 1, []), ("bad", 0.94, 6, ["expect_column_values_to_be_unique"])], "dataset_name string, success_rate double, failure_count long, failed_types array<string>")
    got = rows(alerts.quality_alerts(df, alerts.default_rules()), "dataset_name", "rule_id")
    assert got == [("bad", "critical_expectations"), ("bad", "low_success_rate"), ("bad", "multiple_failures")]


def test_cooldown_burst_against_brute_force(spark):
    """A long burst, ties, pauses, a null key, and a rule without cooldown."""
    rng = random.Random(3)
    data, moment = [], 0.0
    for i in range(4000):
        moment += rng.choice([0, 20, 300, 900, 5000]) if rng.random() < 0.05 else rng.choice([0, 1, 7])
        data.append((i, rng.choice(["a", "a", "a", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=moment), 10))
    data.append((4000, "free", dt.datetime(2024, 1, 1), 0))
    data.append((4001, "free", dt.datetime(2024, 1, 1), 0))
    df = spark.createDataFrame(data, "id int, rule string, at timestamp, minutes int")
    last, expected = {}, []
    for i, rule, at, minutes in sorted(data, key=lambda r: (r[2], r[0])):
        emit = rule not in last or at - last[rule] >= dt.timedelta(minutes=minutes)
        if emit:
            last[rule] = at
        expected.append((i, emit))
    assert rows(alerts.with_cooldown(df, ["rule"], "at", "minutes", "id"), "id", "emitted") == sorted(expected, key=repr)


# -- lineage ------------------------------------------------------------------------------------


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b, f"t{i % 2}") for i, (a, b) in enumerate(pairs)], "source string, target string, transformation string")


def test_reach_stops_at_depth_and_handles_cycles(spark):
    chain = edges_of(spark, *[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)], ("n03", "n01"))
    root = spark.createDataFrame([("n00",)], "node string")
    got = {r["node"]: r["depth"] for r in lineage.reach(chain, root, max_depth=10).collect()}
    assert got == {f"n{i:02d}": i for i in range(1, 11)}
    assert {r["node"]: r["depth"] for r in lineage.reach(chain, root).collect()} == {f"n{i:02d}": i for i in range(1, 15)}
    own = spark.createDataFrame([("n01",)], "node string")
    assert {r["node"]: r["depth"] for r in lineage.reach(chain, own, "upstream").collect()} == {"n00": 1, "n03": 1, "n02": 2, "n01": 3}
    assert lineage.reach(chain, spark.createDataFrame([("n14",)], "node string")).count() == 0


def test_long_chains_are_walked_to_their_end(spark):
    names = [f"n{i:03d}" for i in range(41)]
    chain = edges_of(spark, *zip(names, names[1:]), ("n000", "z"), ("loop", "loop"), ("loop", "n000"))
    assert lineage.shortest_path(chain, "n000", "n040").first()["path"] == names
    assert rows(lineage.circular_assets(chain)) == [("loop",)]


def test_circular_assets_are_those_that_lead_to_a_cycle(spark):
    graph = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "y"))
    assert rows(lineage.circular_assets(graph)) == [("a",), ("b",), ("c",)]
    assert rows(lineage.circular_assets(edges_of(spark, ("a", "b")))) == []
    assert rows(lineage.circular_assets(edges_of(spark, ("a", "a")))) == [("a",)]


def test_shortest_path(spark):
    graph = edges_of(spark, ("a", "b"), ("b", "z"), ("a", "c"), ("c", "d"), ("d", "z"), ("a", "bb"), ("bb", "z"))
    assert lineage.shortest_path(graph, "a", "z").first()["path"] == ["a", "b", "z"]
    assert lineage.shortest_path(graph, "z", "a").count() == 0
    assert lineage.shortest_path(graph, "a", "a").first()["path"] == ["a"]


def test_impact_levels_and_neighbours(spark):
    graph = edges_of(spark, ("a", "b"), ("b", "c"), ("q", "a"))
    root = spark.createDataFrame([("a",), ("c",)], "node string")
    got = lineage.impact_summary(graph, root, lineage.reach(graph, root))
    assert rows(got, "root", "downstream_count", "transformation_count", "risk_level") == [("a", 2, 2, "LOW"), ("c", 0, 0, "MINIMAL")]
    nodes, walked = lineage.neighbourhood(graph, root.filter("node = 'a'"), 1, "both")
    assert rows(nodes, "node", "depth") == [("a", 0), ("b", 1), ("q", 1)]
    assert rows(walked, "source", "target") == [("a", "b"), ("q", "a")]


# -- experiments and statistics -----------------------------------------------------------------


def groups(spark, a, b):
    return spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")


def test_t_test_signs_and_p(spark):
    """Student's sleep data: t = -1.8608 with 18 degrees, p = 0.07919; Welch p = 0.07939."""
    a = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
    b = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    moments = comparison.two_group_moments(groups(spark, a, b), "g", "v", "a", "b")
    student = comparison.t_test(moments).first()
    assert student["statistic"] == pytest.approx(-1.8608, abs=1e-4)
    assert student["p_value"] == pytest.approx(0.07919, abs=1e-5)
    assert (student["ci_lower"], student["ci_upper"]) == (pytest.approx(-0.203874, abs=1e-5), pytest.approx(3.363874, abs=1e-5))
    assert student["cohens_d"] > 0 and student["hedges_g"] < student["cohens_d"]
    welch = comparison.t_test(moments, equal_var=False).first()
    assert welch["degrees_of_freedom"] == pytest.approx(17.776, abs=1e-3)
    assert welch["p_value"] == pytest.approx(0.07939, abs=1e-5)


def test_empty_groups_give_nulls(spark):
    moments = comparison.two_group_moments(groups(spark, [], [1.0]), "g", "v", "a", "b")
    for equal in (True, False):
        assert comparison.t_test(moments, equal_var=equal).first()["p_value"] is None
    assert comparison.mann_whitney(groups(spark, [], []), "g", "v", "a", "b").first()["p_value"] is None
    none = spark.createDataFrame([(0, 0, 0, 0)], "successes_a long, trials_a long, successes_b long, trials_b long")
    assert comparison.proportion_test(none).first()["p_value"] is None
    assert comparison.chi_square(spark.createDataFrame([], "a string, b string"), "a", "b").first()["p_value"] is None


def test_rank_sum_against_brute_force(spark):
    rng = random.Random(11)
    a, b = [rng.randint(0, 9) for _ in range(60)], [rng.randint(2, 12) for _ in range(40)]
    got = comparison.mann_whitney(groups(spark, a, b), "g", "v", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u_statistic"] == u and got["effect_size"] == pytest.approx(1 - 2 * u / 2400)
    assert got["p_value"] < 0.05


def test_two_proportions(spark):
    df = spark.createDataFrame([(50, 200, 75, 200)], "successes_a long, trials_a long, successes_b long, trials_b long")
    got = comparison.proportion_test(df).first()
    assert got["effect_size"] == 0.125
    assert got["statistic"] == pytest.approx(-2.6968, abs=1e-4) and got["p_value"] == pytest.approx(0.007, abs=1e-4)


def test_chi_square_with_empty_cell(spark):
    data = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "q")] * 30 + [("y", "r")] * 5
    got = comparison.chi_square(spark.createDataFrame(data, "a string, b string"), "a", "b").first()
    cells = {("x", "p"): 10, ("x", "q"): 20, ("y", "q"): 30, ("y", "r"): 5}
    r, c = {"x": 30, "y": 35}, {"p": 10, "q": 50, "r": 5}
    expected = sum((cells.get((i, j), 0) - r[i] * c[j] / 65) ** 2 / (r[i] * c[j] / 65) for i in r for j in c)
    assert got["statistic"] == pytest.approx(expected) and got["degrees_of_freedom"] == 2


def test_corrections(spark):
    p = [0.01, 0.03, 0.05, 0.08, 0.12]
    tests = spark.createDataFrame([("f", f"t{i}", v) for i, v in enumerate(p)], "family string, test string, p_value double")

    def corrected(method):
        return [r["corrected_p_value"] for r in comparison.corrected_p(tests, "family", method).orderBy("test").collect()]

    assert corrected("bonferroni") == pytest.approx([0.05, 0.15, 0.25, 0.4, 0.6])
    assert corrected("holm") == pytest.approx([0.05, 0.12, 0.15, 0.16, 0.16])
    assert corrected("benjamini_hochberg") == pytest.approx([0.05, 0.075, 0.25 / 3, 0.1, 0.12])
    assert corrected("sidak") == pytest.approx([1 - (1 - v) ** 5 for v in p])
    h = sum(1 / k for k in range(1, 6))
    assert corrected("benjamini_yekutieli") == pytest.approx([min(v * h, 1) for v in (0.05, 0.075, 0.25 / 3, 0.1, 0.12)])
    big = spark.range(1).select(comparison.harmonic(F.lit(5000)).alias("h")).first()["h"]
    assert big == pytest.approx(sum(1 / k for k in range(1, 5001)), abs=1e-12)


def test_sequential_groups_must_match(spark):
    uneven = comparison.two_group_moments(groups(spark, [1, 2, 3], [1, 2]), "g", "v", "a", "b")
    with pytest.raises(Exception, match="equal sample sizes"):
        comparison.sequential_test(uneven).collect()
    even = comparison.two_group_moments(groups(spark, range(50), range(60, 110)), "g", "v", "a", "b")
    assert comparison.sequential_test(even).first()["decision"] == "reject_h0"


def test_bayesian_directions(spark):
    rng = random.Random(1)
    df = groups(spark, [rng.gauss(10, 2) for _ in range(300)], [rng.gauss(12, 2) for _ in range(300)])
    got = comparison.bayesian(comparison.two_group_moments(df, "g", "v", "a", "b"), 10, 10, (-0.1, 0.1)).first()
    assert got["probability_b_better"] > 0.99 and got["expected_loss_a"] > 1 > got["expected_loss_b"] >= 0
    assert got["ci_lower"] < got["m_b"] - got["m_a"] < got["ci_upper"] and got["rope_probability"] < 0.01


def test_variants_without_data_and_single_value(spark):
    values = spark.createDataFrame([("a", 2.0)], "variant string, value double")
    got = {r["variant"]: tuple(r)[1:] for r in experiments.variant_stats(values, ["a", "b"]).collect()}
    assert got == {"a": (1, 2.0, 0.0, 0.0, 2.0), "b": (0, 0.0, 0.0, 0.0, 0.0)}


def test_values_of_conversions(spark):
    events = spark.createDataFrame([("a", "buy", None), ("a", "buy", 5.0), ("a", "view", None), ("a", "view", 2.0)], "variant string, event_type string, event_value double")
    assert rows(experiments.metric_values(events, "buy"), "value") == [(1.0,), (2.0,), (5.0,)]


def test_stopping_order(spark):
    stats = spark.createDataFrame([("a", 5, 1.0), ("b", 50, 2.0)], "variant string, sample_size long, mean double")
    tests = spark.createDataFrame([("a", "b", 0.01, True)], "variant_a string, variant_b string, p_value double, is_significant boolean")
    start = dt.datetime(2024, 1, 1)
    assert experiments.stopping(stats, tests, 10, 30, start, start).first()["reason"] == "Insufficient sample size for a"
    assert experiments.stopping(stats, tests, 5, 30, start, start).first()["reason"] == "Statistical significance achieved for a_vs_b"
    assert experiments.stopping(stats, tests, 5, 0, start, start).first()["reason"].startswith("Maximum duration")
    assert not experiments.stopping(stats, tests.filter("p_value > 1"), 5, 9, start, start).first()["should_stop"]
    assert tuple(experiments.winner(stats, tests).first()) == ("b", 0.99)


def test_flag_rules(spark):
    df = spark.createDataFrame([("u1", "gold"), ("u2", None), (None, "gold")], "user string, tier string")
    flag = experiments.Flag("f", rules=(experiments.TargetRule({"attr_tier": "gold"}, "g", 1), experiments.TargetRule({"user_id": "u1", "tier": "gold"}, "one", 5)), percentage=100.0)
    assert [r[0] for r in df.select(experiments.flag_value(df, "user", flag)).collect()] == ["one", "true", "g"]
    off = experiments.Flag("f", active=False, percentage=100.0)
    assert {r[0] for r in df.select(experiments.flag_value(df, "user", off)).collect()} == {"false"}


def test_gradual_rollout():
    start = dt.datetime(2024, 1, 1)
    half = experiments.rollout_shares([("c", 50.0), ("t", 50.0)], "c", start, start + dt.timedelta(days=5), 10)
    assert half == [("c", 75.0), ("t", 25.0)]
    assert experiments.rollout_shares([("c", 50.0), ("t", 50.0)], "c", start, start + dt.timedelta(days=50), 10)[1] == ("t", 50.0)


# -- drift and models ---------------------------------------------------------------------------


def long_rows(spark, **columns):
    return spark.createDataFrame([(k, v) for k, values in columns.items() for v in values], "feature_name string, value double")


def test_ks_special_cases(spark):
    ref = long_rows(spark, few=[1.0] * 3, same=[2.0] * 9, other=[2.0] * 9, mixed=[float(i) for i in range(50)])
    cur = long_rows(spark, few=[9.0] * 3, same=[2.0] * 9, other=[3.0] * 9, mixed=[i + 25.0 for i in range(50)] + [float("inf")])
    got = {r["feature_name"]: (r["statistic"], r["p_value"]) for r in drift.kolmogorov_smirnov(ref, cur).collect()}
    assert got["few"] == (0.0, 1.0) and got["same"] == (0.0, 1.0) and got["other"] == (1.0, 0.0)
    assert got["mixed"][0] == pytest.approx(0.5) and got["mixed"][1] < 1e-4


def test_numeric_drift_keeps_zero_mean(spark):
    stats = lambda mean, std: spark.createDataFrame([("f", mean, std)], "feature_name string, mean double, std double")
    assert drift.numeric_drift(stats(25.5, 5.2), stats(30.0, 6.0)).first()["drift_score"] == pytest.approx((4.5 + 0.8) / 10.4)
    assert drift.numeric_drift(stats(0.0, 1.0), stats(0.5, 1.0)).first()["drift_score"] == 0.25
    assert drift.numeric_drift(stats(1.0, 0.0), stats(5.0, 1.0)).first()["drift_score"] == 0.0


def test_categorical_drift_and_status(spark):
    text = lambda **n: spark.createDataFrame([("f", k) for k, c in n.items() for _ in range(c)], "feature_name string, value string")
    got = drift.with_drift_status(drift.categorical_drift(text(a=50, b=30, c=20), text(a=20, b=20, d=10))).first()
    assert (got["new_categories"], got["missing_categories"], got["drift_score"], got["alert_level"]) == (1, 1, 1.0, "error")
    scores = spark.createDataFrame([(0.05,), (0.2,), (0.4,), (0.8,)], "drift_score double")
    assert [r["drift_status"] for r in drift.with_drift_status(scores).collect()] == ["no_drift", "low_drift", "medium_drift", "high_drift"]


def test_changed_categories_are_named_in_a_row(spark, sf):
    mark = lambda names: spark.createDataFrame([(n,) for n in names], "kind string")
    named = drift.changed_names(drift.category_changes(mark(["a", "b", "c"]), mark(["a", "z", "y", None]), ["kind"]))
    assert rows(named) == [("kind", ["y", "z"], ["b", "c"])]
    got = {r["feature_name"]: r for r in QUERIES["feature_drift"](spark, sf).collect()}
    gone = got["priority"]["missing_categories"].split(",")
    assert len(gone) == 5 and got["priority"]["new_categories"].split(",") == [f"to {name}" for name in gone]
    assert (got["o_totalprice"]["new_categories"], got["o_totalprice"]["missing_categories"]) == ("", "")


def test_routes_read_checked_events_from_a_written_table(spark, sf):
    made = QUERIES["event_routes"](spark, sf)
    assert "from_json" not in plan_of(made).lower() and len(made.collect()) == 3


def test_chi_square_scales_and_flags_new_categories(spark):
    text = lambda **n: spark.createDataFrame([("f", k) for k, c in n.items() for _ in range(c)], "feature_name string, value string")
    same = drift.categorical_chi_square(text(a=50, b=50), text(a=20, b=20)).first()
    assert (same["statistic"], same["p_value"]) == (0.0, 1.0)
    new = drift.categorical_chi_square(text(a=50), text(a=20, z=1)).first()
    assert new["statistic"] == float("inf") and new["p_value"] == 0.0


def test_psi_constant_reference(spark):
    assert drift.numeric_psi(long_rows(spark, f=[1.0] * 20), long_rows(spark, f=[1.0] * 20)).first()["psi"] == 0.0
    assert drift.numeric_psi(long_rows(spark, f=[1.0] * 20), long_rows(spark, f=[2.0] * 20)).first()["psi"] == 1.0
    assert drift.numeric_psi(long_rows(spark, f=[1.0] * 5), long_rows(spark, f=[2.0] * 20)).first()["psi"] == 0.0


def test_too_few_rows_give_no_drift_result(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    skipped = drift.input_drift(df, df, ["x"]).first()
    assert (skipped["status"], skipped["statistic"], skipped["severity"]) == ("too_few_rows", None, None)
    assert drift.input_drift(df, df, ["x"], min_samples=50).first()["severity"] == "low"


def test_degradation_direction(spark):
    df = spark.createDataFrame([("acc", 0.8, 0.72), ("mse", 1.0, 1.4)], "metric string, baseline_value double, current_value double")
    got = rows(models.degradation(df), "metric", "performance_degraded", "severity", "direction")
    assert got == [("acc", True, "medium", "down"), ("mse", True, "critical", "up")]


def test_scoring_reports_failures_per_row(spark):
    class Broken:
        def predict(self, matrix):
            raise RuntimeError("no")

    df = spark.createDataFrame([(1, [1.0, 2.0], "ok"), (2, [1.0, 2.0], "bad"), (3, [0.0, 0.0], None)], "id int, features array<double>, model string")
    got = models.score(df, "id", "features", "model", {"ok": models.LinearModel([1.0, 2.0], 0.5), "bad": Broken()})
    assert rows(got, "id", "prediction", "status") == [(1, 5.5, "success"), (2, None, "error: no"), (3, None, "model_not_found")]


def test_scoring_keeps_one_bad_vector_to_itself(spark):
    data = [(i, [1.0, 2.0], "ok") for i in range(6)] + [(6, [1.0], "ok"), (7, None, "ok"), (8, [], "ok"), (9, [1.0, None], "ok")]
    df = spark.createDataFrame(data, "id int, features array<double>, model string").coalesce(1)
    got = {r["id"]: r for r in models.score(df, "id", "features", "model", {"ok": models.LinearModel([1.0, 2.0], 0.5)}).collect()}
    assert all(got[i]["status"] == "success" and got[i]["prediction"] == 5.5 for i in range(6))
    assert all(got[i]["status"].startswith("error: ") for i in (6, 7, 8))


def test_as_many_missing_vectors_as_a_model_has_weights_are_errors(spark):
    df = spark.createDataFrame([(i, None if i < 2 else [1.0, 2.0], "ok") for i in range(4)], "id int, features array<double>, model string").coalesce(1)
    got = models.score(df, "id", "features", "model", {"ok": models.LinearModel([1.0, 2.0], 0.5)})
    assert rows(got, "id", "prediction", "status") == [(0, None, "error: no vector"), (1, None, "error: no vector"), (2, 5.5, "success"), (3, 5.5, "success")]


# -- features -----------------------------------------------------------------------------------


def test_feature_rows_pick_the_entity(spark):
    df = spark.createDataFrame([(30, "u1", 50000)], "age long, entity_id string, income long")
    got = features.feature_rows(df, {"user_age": "$age", "income_k": "$income / 1000", "": "$age"})
    assert rows(got, "entity_id", "feature_name", "value") == [("u1", "income_k", "50.0"), ("u1", "user_age", "30")]
    assert features.feature_rows(df.drop("entity_id"), {"x": "$income"}).first()["entity_id"] == "30"


def test_interval_reads_are_half_open(spark):
    data = [("e", "f", "1", "2024-01-01", "2024-01-01", "2024-01-05"), ("e", "f", "2", "2024-01-02", "2024-01-05", None), ("e", "f", "3", "2024-01-03", "2024-01-09", None)]
    values = stamps(spark.createDataFrame(data, "entity_id string, feature_name string, feature_value string, created_at string, valid_from string, valid_until string"), "created_at", "valid_from", "valid_until")
    read = lambda at: {r["entity_id"]: r["f"] for r in features.read_valid_at(values, ["f"], ["e", "nobody"], at).collect()}
    assert read("2024-01-04") == {"e": "1", "nobody": None}
    assert read("2024-01-05") == {"e": "2", "nobody": None}
    assert read(None) == {"e": "3", "nobody": None}


def test_served_null_is_not_replaced(spark):
    values = stamps(spark.createDataFrame([("e", "f", None, "2024-01-01")], "entity_id string, feature_name string, value string, timestamp string"), "timestamp")
    entities = spark.createDataFrame([("e",), ("g",)], "entity_id string")
    assert rows(features.serve(values, ["f"], entities, {"f": 7})) == [("e", None), ("g", "7")]


def test_value_types(spark):
    rows_ = spark.createDataFrame([("s", '"abcd"'), ("s", "5"), ("i", "5"), ("i", "5.5"), ("b", "true"), ("t", '"2024-01-01"')], "feature_name string, value string")
    definitions = spark.createDataFrame(
        [("s", "string", None, None, 3), ("i", "integer", 6.0, None, None), ("b", "boolean", None, None, None), ("t", "timestamp", None, None, None)],
        "feature_name string, feature_type string, min_value double, max_value double, max_length int",
    )
    got = {(r["feature_name"], r["value"]): r["errors"] for r in features.validate_values(rows_, definitions).collect()}
    assert got[("s", '"abcd"')] == ["too long"] and got[("s", "5")] == ["expected string"]
    assert got[("i", "5")] == ["below minimum"] and got[("i", "5.5")] == ["expected integer", "below minimum"]
    assert got[("b", "true")] == [] and got[("t", '"2024-01-01"')] == []


# -- run logs -----------------------------------------------------------------------------------


def test_runs_without_durations_or_tasks(spark):
    df = spark.createDataFrame([("w", "success", None, 0, 0, 0)], "workflow_name string, status string, duration_seconds double, total_tasks long, completed_tasks long, failed_tasks long")
    got = runlog.with_health(runlog.run_metrics(df)).first()
    assert (got["avg_duration_seconds"], got["task_success_rate"], got["health_score"]) == (0.0, 0.0, 90.5)


def test_latency_of_few_values(spark):
    df = spark.createDataFrame([(float(v), True) for v in (10, 20, 30)], "ms double, ok boolean")
    got = runlog.latency_summary(df, "ms", "ok").first()
    assert got["p95_latency"] == pytest.approx(statistics.quantiles([10, 20, 30], n=20)[18])
    assert got["p99_latency"] == 30.0
    empty = runlog.latency_summary(df.limit(0), "ms", "ok").first()
    assert (empty["p95_latency"], empty["avg_latency"], empty["success_rate"]) == (0.0, 0.0, 0.0)


# -- sources ------------------------------------------------------------------------------------


@pytest.mark.parametrize("suffix", ["csv", "parquet", "json"])
def test_file_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    files.write_file(df, f"{tmp_path}/x.{suffix}")
    assert rows(files.read_file(spark, f"{tmp_path}/x.{suffix}", "n int, t string"), "n", "t") == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        files.read_file(spark, "x.xml")


def test_reports_and_database_options(spark, tmp_path):
    files.write_report({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path), "json")
    assert spark.read.json(f"{tmp_path}/a.json").count() == 3
    with pytest.raises(ValueError):
        files.write_report({}, str(tmp_path), "pdf")
    options = files.jdbc_options("jdbc:x", "SELECT 1", user="u", split_column="id", split_range=(0, 9), splits=3)
    assert options["dbtable"] == "(SELECT 1) AS source" and options["numPartitions"] == "3" and "query" not in options


@pytest.mark.parametrize("name", ["", "a;b", "drop_me", "a b", "x" * 129, "a--b"])
def test_bad_identifiers(name):
    with pytest.raises(ValueError):
        catalog.checked_identifier(name)


@pytest.mark.parametrize("limit", [0, 10001, "5", True])
def test_sample_limits(spark, limit):
    with pytest.raises(ValueError):
        catalog.sample_table(spark, "t", limit=limit)


def test_ingestion(spark, tmp_path):
    source, target = f"{tmp_path}/in.parquet", f"{tmp_path}/out.json"
    spark.createDataFrame([(1, "a"), (1, "b")], "id int, t string").write.parquet(source)
    unique = [{"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "id"}}]
    failed = ingest(spark, source, target, "t", unique, fail_on_error=True)
    assert failed.status == "failed" and not (tmp_path / "out.json").exists()
    done = ingest(spark, source, target, "t")
    assert done.status == "success" and done.rows == 2 and not done.warnings
    assert rows(done.edges) == [(source, "t", "ingest_t")] and done.profile.first()["row_count"] == 2
    assert spark.read.json(target).count() == 2


def test_rows_a_microsecond_apart_are_different(spark, tmp_path):
    times = [dt.datetime(2024, 1, 1, 0, 0, 0, micro) for micro in (123, 124, 123)]
    df = spark.createDataFrame([(t, t, "a,b") for t in times], "at timestamp, wall timestamp_ntz, t string")
    assert profiling.table_profile(df).first()["duplicate_rows"] == 1
    for kind in ("csv", "json"):
        files.write_file(df, f"{tmp_path}/x.{kind}")
        assert rows(files.read_file(spark, f"{tmp_path}/x.{kind}", df.schema)) == rows(df)


def test_most_frequent_ties_go_by_the_text(spark):
    long = ["a" * 70, "a" * 64 + "b", "a" * 64]
    df = spark.createDataFrame([(t,) for t in [*long, "b", "b" * 90, None]] , "t string")
    top = profiling.top_categories(df, n=3).orderBy("rank").collect()
    assert [r["value"] for r in top] == ["a" * 64, "a" * 70, "a" * 64 + "b"]
    assert profiling.column_profile(df).first()["most_frequent_value"] == "a" * 64


def test_pivot_loses_no_cell(spark):
    cells = spark.createDataFrame([("r", "x", 1, "p"), ("r", "x", 2, "q"), ("s", "y", 3, "p")], "row string, c string, m int, other string")
    with pytest.raises(Exception, match="several cells"):
        olap.pivot_wide(cells, ["row"], "c", ["x", "y"], "m").collect()
    with pytest.raises(Exception, match="no column for c = y"):
        olap.pivot_wide(cells, ["row"], "c", ["x"], "m").collect()
    assert rows(olap.pivot_wide(cells.filter("m <> 2"), ["row"], "c", ["x", "y"], "m")) == [("r", 1, None), ("s", None, 3)]


def test_a_source_that_fails_while_it_runs_is_reported(spark):
    good = spark.createDataFrame([(1, "a")], "id int, t string")
    bad = good.withColumn("id", F.raise_error(F.concat(F.lit("down "), "t")).cast("int"))
    result = federation.federate({"bad": lambda: bad, "good": lambda: good})
    assert not result.success and list(result.errors) == ["bad"] and rows(result.combined) == [(1, "a")]


def test_tails_hold_at_any_size(spark):
    assert tails.student_two_sided(2.0, 1e13) == pytest.approx(tails.normal_two_sided(2.0), abs=1e-9)
    assert tails.student_two_sided(2.0, 1e4) == pytest.approx(0.0455273, abs=1e-6)
    assert tails.student_two_sided(1.0, 1.0) == pytest.approx(0.5) and tails.beta_share(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    h = spark.range(1).select(*[comparison.harmonic(F.lit(m)).alias(f"h{m}") for m in (1, 2, 999, 1001)]).first()
    assert list(h) == pytest.approx([sum(1 / k for k in range(1, m + 1)) for m in (1, 2, 999, 1001)], abs=1e-12)


# -- plans that must hold at scale --------------------------------------------------------------


def test_plans_never_use_a_cartesian_product(spark, sf):
    from quillon.plans.catalogue import QUERIES

    for name in ("top_nations_in_region", "variant_t_tests", "tumbling_percentiles", "ks_per_feature", "features_served", "quality_alerts"):
        assert "CartesianProduct" not in plan_of(QUERIES[name](spark, sf)), name
        assert "BroadcastNestedLoopJoin" not in plan_of(QUERIES[name](spark, sf)), name


def test_quantiles_never_sort_a_key_in_one_task(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plan = plan_of(quantiles(events, ["event_type"], "value", {"p": indexed_quantile("value", 50)}))
    sorts = [line for line in plan.splitlines() if "Sort [event_type" in line and "value" in line]
    assert sorts and all("_range" in line for line in sorts)


def test_last_row_per_key_needs_no_window(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plan = plan_of(federation.last_per_key(orders, ["o_custkey"], "o_orderkey"))
    assert "Window" not in plan and "partial_max" in plan

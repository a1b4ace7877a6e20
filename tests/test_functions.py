"""Expressions, paths, hashing, exact ranks and tails."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillon.functions import tails
from quillon.functions.expressions import feature_column
from quillon.functions.hashing import md5_mod, pick_by_share
from quillon.functions.ordering import indexed_quantile, linear_quantile, ordered_counts, quantiles
from quillon.functions.paths import matches, nested, numeric
from quillon.functions.timeline import with_previous


def value(spark, expression, **columns):
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    return df.select(feature_column(expression, df.columns)).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("$a + $b * 2", 7 + -3 * 2),
        ("$a // $b", 7 // -3),
        ("$a % $b", 7 % -3),
        ("-$a % 3", -7 % 3),
        ("$a / 2", 3.5),
        ("$a ** 2", 49),
        ("round($a / 2)", round(3.5)),
        ("round(2.5)", 2),
        ("max($a, $b, 10) - min($a, $b)", 13),
        ("abs($b) + sqrt(16)", 7),
        ("exp(0) + log(1) + sin(0) + cos(0) + tan(0)", 2),
        ("+$a", 7),
    ],
)
def test_expressions_follow_python(spark, text, expected):
    assert value(spark, text, a=7, b=-3) == pytest.approx(expected)


@pytest.mark.parametrize("text", ["$a / 0", "$a // 0", "$a % 0", "sqrt(-1 * $a)", "log($a - 7)", "0 ** (-1 * $a)", "exp($a * 1000)"])
def test_expression_failures_are_null(spark, text):
    assert value(spark, text, a=7, b=2) is None


def test_longer_column_names_are_not_cut(spark):
    assert value(spark, "$ab - $a", a=1, ab=10) == 9


@pytest.mark.parametrize("text", ["__import__('os')", "$a.real", "$missing", "[1, 2]", "$a if $a else 1", "open($a)", "$a +"])
def test_other_python_is_refused(spark, text):
    with pytest.raises(ValueError):
        value(spark, text, a=1)


def test_nested_paths(spark):
    df = spark.createDataFrame(
        [('{"a": {"b": 5, "t": "5", "f": true}}', (1, "x"), {"k": "v"})],
        "js string, st struct<n:int, s:string>, mp map<string,string>",
    )
    got = df.select(
        nested(df, "js.a.b"), nested(df, "st.n"), nested(df, "mp.k"), nested(df, "mp.z"), nested(df, "st.q"), nested(df, "no.thing"),
        numeric(df, "js.a.b"), numeric(df, "js.a.t"), numeric(df, "js.a.f"), numeric(df, "st.n"),
    ).first()
    assert tuple(got) == ("5", 1, "v", None, None, None, 5.0, None, 1.0, 1.0)


def test_filter_on_missing_path_is_false(spark):
    df = spark.createDataFrame([("click", 1), ("view", None)], "kind string, n int")
    assert rows(df.filter(matches(df, {"kind": ["click", "view"], "n": 1}))) == [("click", 1)]
    assert df.filter(matches(df, {"other": 1})).count() == 0
    assert df.filter(matches(df, {})).count() == 2
    assert df.filter(matches(df, {"kind": []})).count() == 0


@pytest.mark.parametrize("modulus", [100, 10000])
def test_md5_modulus(spark, modulus):
    texts = [f"exp:{i}" for i in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", md5_mod(F.col("t"), modulus)).collect()
    assert all(r[1] == int(hashlib.md5(r[0].encode()).hexdigest(), 16) % modulus for r in got)


def test_share_bounds(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.01,), (30.0,), (30.01,)], "p double")
    shares = [("a", 10.0), ("b", 20.0)]
    assert [r[0] for r in df.select(pick_by_share(F.col("p"), shares, True)).collect()] == ["a", "a", "b", "b", None]
    assert [r[0] for r in df.select(pick_by_share(F.col("p"), shares, False)).collect()] == ["a", "b", "b", None, None]


def test_ordered_counts_against_brute_force(spark):
    """A hot key, a hot value, a null key and null values."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, 7.0, rng.randint(0, 400) / 4])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {(r["k"], r["v"]): (r["n"], r["n_before"], r["n_total"]) for r in ordered_counts(df, ["k"], "v").collect()}
    expected = {}
    for key in {k for k, _ in data}:
        values = sorted(v for k, v in data if k == key and v is not None)
        for v in set(values):
            expected[(key, v)] = (values.count(v), sum(x < v for x in values), len(values))
    assert got == expected


def test_quantile_definitions(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "v double")
    got = quantiles(
        df, [], "v",
        {"q1": linear_quantile("v", 0.25), "q9": linear_quantile("v", 0.9), "i50": indexed_quantile("v", 50), "i100": indexed_quantile("v", 100)},
    ).first()
    assert tuple(got) == (2.0, pytest.approx(7.6), 3.0, 10.0)


def test_previous_value_crosses_slices(spark):
    df = spark.createDataFrame([("a", i, f"2024-01-01 0{i // 4}:{(i % 4) * 15:02d}:00", i) for i in range(12)], "k string, id int, t string, v int")
    looked = with_previous(df.withColumn("t", F.to_timestamp("t")), ["k"], "t", "id", F.col("v"), "before", 3600)
    assert rows(looked, "v", "before") == sorted([(i, i - 1 if i else None) for i in range(12)], key=repr)


def test_tails_against_published_tables():
    assert tails.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.student_two_sided(2.576, 1e7) == pytest.approx(0.01, abs=1e-4)
    assert tails.student_point(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.student_point(0.025, 5) == pytest.approx(-2.570582, abs=1e-5)
    assert tails.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi_square_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi_square_tail(0.0, 3) == 1.0
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_point(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert tails.kolmogorov_tail(1.3581) == pytest.approx(0.05, abs=1e-4)
    assert tails.kolmogorov_tail(1.6276) == pytest.approx(0.01, abs=1e-4)
    assert tails.beta_share(2, 3, 0.5) == pytest.approx(0.6875)
    assert math.isclose(tails.chi_square_tail(400, 300), 9.6e-05, rel_tol=0.2)


def all_orders(m, n):
    return itertools.combinations(range(m + n), m)


@pytest.mark.parametrize("m, n", [(3, 4), (5, 5), (2, 7), (7, 2), (1, 6)])
def test_exact_tails_against_all_orders(m, n):
    sums, gaps = [], []
    for chosen in all_orders(m, n):
        own, i, j, gap = set(chosen), 0, 0, 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in own else (i, j + 1)
            gap = max(gap, abs(i * n - j * m))
        gaps.append(gap)
        sums.append(sum(chosen) - m * (m - 1) // 2)
    for k in range(1, m * n + 1):
        assert tails.kolmogorov_exact(k / (m * n), m, n) == pytest.approx(sum(g >= k for g in gaps) / len(gaps), abs=1e-12)
    for u in range(m * n + 1):
        low = sum(s <= min(u, m * n - u) for s in sums)
        assert tails.rank_sum_exact(u, m, n) == pytest.approx(min(1.0, 2 * low / len(sums)), abs=1e-12)


def plain_kolmogorov(gap, m, n):
    """Paths counted in whole numbers, row by row."""
    inside = [int(abs(j * m) < round(gap * m * n)) for j in range(n + 1)]
    for i in range(1, m + 1):
        row, before = [], 0
        for j in range(n + 1):
            before = (inside[j] + before) if abs(i * n - j * m) < round(gap * m * n) else 0
            row.append(before)
        inside = row
    return 1 - inside[n] / math.comb(m + n, n)


@pytest.mark.parametrize("m, n, gap", [(20, 30, 17 / 60), (500, 700, 0.08), (700, 500, 0.08), (60, 45, 0.5), (50, 50, 1.0)])
def test_exact_kolmogorov_tail_of_larger_samples(m, n, gap):
    k = round(gap * m * n)
    assert tails.kolmogorov_exact(k / (m * n), m, n) == pytest.approx(plain_kolmogorov(k / (m * n), m, n), abs=1e-11)


def test_exact_tails_agree_with_their_limits():
    assert tails.kolmogorov_exact(0.02, 10_000, 10_000) == pytest.approx(tails.kolmogorov_tail(0.02 * 5000**0.5), rel=1e-3)
    m, n = 8, 4000  # eight values among many: U nearly is a sum of eight uniform numbers, which is nearly normal
    u = m * n / 2 - 1.5 * (m * n * (m + n + 1) / 12) ** 0.5
    assert tails.rank_sum_exact(u, m, n) == pytest.approx(tails.normal_two_sided(1.5), rel=0.03)


def test_posterior_against_plain_sums():
    """Chances of the difference from sums over a fine grid of both means and both deviations."""
    prior, a, b = (1.0, 2.0), (12, 0.5, 1.3), (9, 1.1, 0.7)
    means, deviations = [-3 + 0.02 * k for k in range(400)], [0.02 + 0.02 * k for k in range(250)]

    def marginal(n, m, v):
        out = []
        for mean in means:
            total = 0.0
            for s in deviations:
                total += math.exp(-n * math.log(s) - ((n - 1) * v + n * (m - mean) ** 2) / (2 * s * s) - s * s / 2)
            out.append(total * math.exp(-((mean - prior[0]) ** 2) / (2 * prior[1] ** 2)))
        return [x / sum(out) for x in out]

    pa, pb = marginal(*a), marginal(*b)
    better, loss, inside = 0.0, 0.0, 0.0
    for x, p in zip(means, pa):
        for y, q in zip(means, pb):
            better += p * q * ((y > x) + 0.5 * (y == x))
            loss += p * q * max(y - x, 0)
            inside += p * q * (abs(y - x) <= 0.5)
    got = tails.difference_posterior(a, b, prior, (-0.5, 0.5))
    assert got[0] == pytest.approx(better, abs=2e-3) and got[1] == pytest.approx(loss, abs=5e-3) and got[5] == pytest.approx(inside, abs=0.02)
    assert got[3] < got[1] - got[2] < got[4]

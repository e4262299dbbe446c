"""Statistics against numpy and published values, p-values against the distributions shipped with Spark."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabprep.functions import pvalues as D
from tabprep.operators import stats as T
from tabprep.operators.stats.normality import ANDERSON_5PCT, shapiro

# A published example: weights in pounds of eleven men (Snedecor & Cochran).
WEIGHTS = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float)


@pytest.fixture(scope="module")
def dist(spark):
    return spark._jvm.org.apache.commons.math3.distribution


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(42)
    frame = pd.concat(
        pd.DataFrame({"g": g, "v": rng.normal(m, 2, 30)}) for g, m in (("A", 10), ("B", 20), ("C", 30))
    )
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("t, dof", [(0.0, 5), (1.3, 3), (-2.4, 17.5), (5.0, 100), (40.0, 9)])
def test_t_tail(dist, t, dof):
    cdf = dist.TDistribution(float(dof)).cumulativeProbability(float(t))
    assert D.t_tail(t, dof, "less") == pytest.approx(cdf, abs=1e-12)
    assert D.t_tail(t, dof, "greater") == pytest.approx(1 - cdf, abs=1e-12)
    assert D.t_tail(t, dof) == pytest.approx(2 * min(cdf, 1 - cdf), abs=1e-12)


@pytest.mark.parametrize("f, a, b", [(0.5, 2, 10), (3.2, 4, 95), (20.0, 1, 7), (1.0, 30, 30)])
def test_f_tail(dist, f, a, b):
    assert D.f_tail(f, a, b) == pytest.approx(1 - dist.FDistribution(float(a), float(b)).cumulativeProbability(f), abs=1e-12)


@pytest.mark.parametrize("x, k", [(0.1, 1), (3.84, 1), (20.0, 4), (150.0, 120), (0.0, 3)])
def test_chi2_tail(dist, x, k):
    assert D.gamma_tail(k / 2, x / 2) == pytest.approx(1 - dist.ChiSquaredDistribution(float(k)).cumulativeProbability(x), abs=1e-11)


@pytest.mark.parametrize("q, k, dof", [(3.578, 3, 20), (3.977, 5, 60), (3.314, 3, 1e6)])
def test_studentized_range_table(q, k, dof):
    assert D.studentized_range_tail(q, k, dof) == pytest.approx(0.05, abs=2e-4)


def test_exact_rank_tests():
    assert D.rank_sum_p(9, 3, 3, 0, "two-sided") == pytest.approx(0.1)
    assert D.rank_sum_p(4.0, 3, 3, 0, "greater") == pytest.approx(13 / 20)
    assert D.signed_rank_p(21, 6, 0, "two-sided") == pytest.approx(2 / 64)
    assert D.signed_rank_p(0, 6, 0, "greater") == pytest.approx(1.0)


def test_published_normality_values():
    w, p = D.shapiro_wilk(WEIGHTS)
    assert w == pytest.approx(0.7888147, abs=1e-5) and p == pytest.approx(0.0067038, abs=1e-5)
    w, p = D.shapiro_wilk(np.arange(1.0, 11.0))
    assert w == pytest.approx(0.97016, abs=1e-4) and p == pytest.approx(0.8924, abs=1e-3)
    c = WEIGHTS - WEIGHTS.mean()
    skew, kurt = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3
    assert D.k_squared(11, skew, kurt) == pytest.approx(13.034263, abs=1e-5)


def test_log_normal_cdf_far_tail():
    got = D.log_normal_cdf.func(pd.Series([0.0, -40.0, 3.0]))
    assert got[0] == pytest.approx(math.log(0.5)) and got[1] == pytest.approx(-804.608, abs=1e-2)


def test_one_sample(spark):
    x = np.random.default_rng(42).normal(5, 1, 100)
    r = T.one_sample_ttest(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 5.0).first()
    t = (x.mean() - 5) / (x.std(ddof=1) / 10)
    assert r.t_statistic == pytest.approx(t, abs=1e-4) and r.p_value == pytest.approx(D.t_tail(t, 99), abs=1e-6)
    assert not r.reject_null and r.error is None


def test_too_few_values_report_an_error(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    assert "Insufficient" in T.one_sample_ttest(one, "x", 0.0, by="g").first().error
    assert "Insufficient" in T.two_sample_ttest(one, "x", "g", "a", "b").first().error
    assert "Insufficient" in T.normality(one, "x").first().error
    assert T.normality(one, "x").first().is_normal is None


def test_two_samples_and_anova_agree(groups):
    two = T.two_sample_ttest(groups, "v", "g", "A", "B").first()
    assert two.reject_null and two.effect_size == "Large effect"
    pair = groups.filter("g in ('A', 'B')")
    anova = T.one_way_anova(pair, "v", "g").first()
    assert anova.f_statistic == pytest.approx(two.t_statistic**2, rel=1e-5)
    assert anova.levene_statistic == pytest.approx(two.levene_statistic, abs=1e-3)


def test_anova_leaves_out_small_groups(spark, groups):
    lonely = groups.unionByName(spark.createDataFrame([("D", 99.0)], "g string, v double"))
    assert T.one_way_anova(lonely, "v", "g").first() == T.one_way_anova(groups, "v", "g").first()
    assert T.kruskal_wallis(lonely, "v", "g").first() == T.kruskal_wallis(groups, "v", "g").first()
    assert {r.g for r in T.group_statistics(lonely, "v", "g").collect()} == {"A", "B", "C"}


def test_tukey_pairs(groups):
    out = T.tukey_pairs(groups, "v", "g").collect()
    assert [(r.group1, r.group2) for r in out] == [("A", "B"), ("A", "C"), ("B", "C")]
    assert all(r.p_value < 0.001 for r in out)


def test_paired(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(10, 2, 50)
    a = b + rng.normal(1, 0.5, 50)
    r = T.paired_ttest(spark.createDataFrame(pd.DataFrame({"b": b, "a": a})), "b", "a").first()
    assert r.mean_difference > 0 > r.t_statistic and r.reject_null


def test_two_by_two_is_corrected(spark):
    rows = [("m", "x")] * 10 + [("m", "y")] * 20 + [("f", "x")] * 25 + [("f", "y")] * 5
    r = T.chi_square_independence(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    o = np.array([[10, 20], [25, 5]])
    e = o.sum(1, keepdims=True) * o.sum(0) / 60
    assert r.chi_square == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum(), abs=1e-4) and r.dof == 1


def test_empty_cells_count(spark):
    rows = [("m", "x")] * 10 + [("f", "y")] * 5 + [("f", "z")] * 7 + [("m", "z")] * 3
    r = T.chi_square_independence(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    o = np.array([[10, 0, 3], [0, 5, 7]])
    e = o.sum(1, keepdims=True) * o.sum(0) / 25
    assert r.chi_square == pytest.approx(((o - e) ** 2 / e).sum(), abs=1e-4)


def test_goodness_of_fit(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20, "x string")
    assert T.chi_square_goodness_of_fit(df, "x").first().chi_square == pytest.approx(14.0)
    assert T.chi_square_goodness_of_fit(df, "x", [50, 30, 20]).first().chi_square == 0.0
    with pytest.raises(ValueError):
        T.chi_square_goodness_of_fit(df, "x", [50, 50])


def test_mann_whitney_matches_brute_force(spark, small_ranges):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 20, 120), rng.integers(3, 25, 90)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 120 + ["b"] * 90, "v": np.concatenate([a, b]).astype(float)}))
    r = T.mann_whitney_u(df, "v", "g", "a", "b").first()
    u = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum())
    assert r.u_statistic == pytest.approx(u) and r.reject_null
    assert r.group1_median == np.median(a)


def test_wilcoxon_matches_brute_force(spark, small_ranges):
    rng = np.random.default_rng(4)
    d = rng.integers(-8, 12, 200).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": np.zeros(200), "y": d}))
    r = T.wilcoxon_signed_rank(df, "x", "y").first()
    nz = d[d != 0]
    ranks = pd.Series(abs(nz)).rank()
    assert r.n_observations == nz.size
    assert r.w_statistic == pytest.approx(min(ranks[nz > 0].sum(), ranks[nz < 0].sum()))


def test_normality_votes(spark):
    rng = np.random.default_rng(42)
    frame = pd.concat([pd.DataFrame({"k": "normal", "v": rng.normal(0, 1, 200)}),
                       pd.DataFrame({"k": "skewed", "v": rng.exponential(1, 200)})])
    out = {r.k: r for r in T.normality(spark.createDataFrame(frame), "v", by="k").collect()}
    assert out["normal"].is_normal and not out["skewed"].is_normal
    assert out["normal"].total_tests == 3


def test_anderson_darling_matches_the_formula(spark, small_ranges):
    x = np.sort(np.random.default_rng(8).normal(3, 2, 150).round(1))
    z = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([1 - D.normal_tail(v) for v in z])
    i = np.arange(1, 151)
    want = -150 - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).sum() / 150
    r = T.anderson_darling(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    assert r.statistic == pytest.approx(want, abs=1e-6)
    assert r.critical_value_5pct == pytest.approx(ANDERSON_5PCT, abs=0.01)


def test_large_groups_skip_shapiro(spark):
    df = spark.range(6000).selectExpr("CAST(id AS DOUBLE) AS v")
    r = T.normality(df, "v").first()
    assert r.shapiro_wilk_statistic is None and r.total_tests == 2


def test_outliers(spark):
    x = np.concatenate([np.random.default_rng(42).normal(50, 5, 95), [100.0, -100.0]])
    df = spark.createDataFrame(pd.DataFrame({"_ord": np.arange(97), "x": x}))
    assert T.iqr_report(df, "x").first().n_outliers >= 2
    assert {95, 96} <= {r._ord for r in T.iqr_outliers(df, "x").collect()}
    assert T.zscore_report(df, "x").first().n_outliers == 2


def test_zero_deviation_is_an_error(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert "zero" in T.zscore_report(df, "x").first().error
    assert T.zscore_outliers(df, "x").count() == 0


def test_unknown_alternative(spark):
    with pytest.raises(ValueError):
        T.one_sample_ttest(spark.createDataFrame([(1.0,)], "x double"), "x", 0.0, alternative="both")


def test_exact_rank_test_with_one_large_sample():
    assert D.rank_sum_exact_tail(2_600_000, 1_000_000, 5) == pytest.approx(0.44, abs=1e-3)
    assert D.rank_sum_exact_tail(7, 5, 3) == pytest.approx(D.rank_sum_exact_tail(7, 3, 5))


def test_tukey_counts_groups_before_listing_them(spark):
    df = spark.range(40).selectExpr("cast(id % 20 as string) AS g", "cast(id * id % 7 as double) AS v", "id % 2 AS k")
    assert T.tukey_pairs(df, "v", "g", max_groups=20).count() == 190
    assert T.tukey_pairs(df, "v", "g", by="k", max_groups=10).count() == 90
    with pytest.raises(Exception, match="More than 19 groups"):
        T.tukey_pairs(df, "v", "g", max_groups=19).count()


def _plain_levene(groups):
    z = [np.abs(g - np.median(g)) for g in groups if len(g) >= 2]
    n, grand = sum(map(len, z)), np.concatenate(z).mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in z) / (len(z) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in z) / (n - len(z))
    return between / within


@pytest.mark.parametrize("offset, kind", [(0, "normal"), (1e6, "normal"), (-50, "ties"), (3, "odd")])
def test_levene_against_numpy(spark, small_ranges, offset, kind):
    rng = np.random.default_rng(3)
    sizes = (7, 41, 121) if kind == "odd" else (8, 40, 120, 1)
    groups = [rng.normal(offset, s + 1, n) for s, n in enumerate(sizes)]
    if kind == "ties":
        groups = [g.round() for g in groups]
    frame = pd.DataFrame({"_value": np.concatenate(groups), "_g0": np.repeat([f"g{i}" for i in range(len(sizes))], sizes)})
    rows = spark.createDataFrame(pd.concat([frame.assign(part="a"), frame.assign(part="b", _value=2 * frame["_value"])])).repartition(3)
    rows = rows.unionByName(spark.createDataFrame([(None, "g0", "a"), (5.0, None, "a")], "_value double, _g0 string, part string"))
    for r in T.levene(rows, "_value", "_g0", "part").collect():
        assert r.statistic == pytest.approx(_plain_levene(groups), abs=1e-4)
    assert T.levene(rows.filter("part = 'a'"), "_value", "_g0").first().statistic == pytest.approx(_plain_levene(groups), abs=1e-4)


def test_levene_of_equal_distances(spark):
    rows = [(g, m + d) for g, m in (("a", 0.1), ("b", 7.3)) for d in (-0.3, 0.3)]
    assert T.levene(spark.createDataFrame(rows, "g string, v double"), "v", "g").first().statistic is None


def test_normal_expressions(spark):
    from statistics import NormalDist

    from tabprep.functions import normal as N

    zs = [float(z) for z in np.concatenate([np.linspace(-38, 12, 401), [0.0, -0.66, 0.67, -5.6568, 5.657, -200.0]])]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", N.log_normal_cdf(F.col("z")).alias("l")).collect()
    for r in got:
        tail = math.erfc(-r.z / math.sqrt(2)) / 2
        want = (math.log(tail) if r.z < 0 else math.log1p(-math.erfc(r.z / math.sqrt(2)) / 2)) if tail > 1e-300 else -r.z * r.z / 2 - math.log(-r.z * math.sqrt(2 * math.pi)) + math.log1p(-1 / r.z**2 + 3 / r.z**4)
        assert r.l == pytest.approx(want, rel=1e-13 if abs(r.z) < 37 else 1e-9, abs=1e-300)
    ps = [float(p) for p in np.concatenate([np.linspace(0.001, 0.999, 333), [1e-9, 1e-5, 0.02425, 0.5, 1 - 1e-9]])]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("q", N.first_normal_quantile(F.col("p")))
    for r in rows.withColumn("x", N.refined_quantile(F.col("q"), F.col("p"))).collect():
        assert r.x == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-14)


def test_shapiro_by_group_equals_the_plain_routine(spark):
    rng = np.random.default_rng(12)
    samples = {f"n{n}": rng.normal(1e3, 2, n) for n in (8, 9, 11, 12, 50, 700)}
    samples |= {f"e{n}": rng.exponential(3, n) for n in (10, 30, 300)}
    samples |= {"ties": rng.normal(0, 1, 60).round(1), "few": rng.normal(size=7), "same": np.full(20, 2.5), "line": np.arange(9.0)}
    rows = [(g, float(v)) for g, s in samples.items() for v in s] + [("n8", None), (None, 1.0)]
    got = {r.g: r for r in shapiro(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", by="g").collect()}
    assert set(got) == set(samples) - {"few"}
    for g, r in got.items():
        w, p = D.shapiro_wilk(samples[g])
        assert (r.statistic, r.p_value) == (pytest.approx(w, abs=1.1e-6), pytest.approx(p, abs=1.1e-6)) and r.is_normal == (p > 0.05)


def test_wide_projections_are_compiled_and_the_setting_is_put_back(spark):
    from tabprep.storage import compiled

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), compiled(spark):
        assert spark.conf.get(key) == "8000"
        1 / 0
    assert spark.conf.get(key) == before

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ebbline.operators import adjust as A
from ebbline.operators import effects as E
from tests.conftest import SMALL


def brute_chi_square(pairs):
    rows, columns, cells = Counter(a for a, _ in pairs), Counter(b for _, b in pairs), Counter(pairs)
    n, dof = len(pairs), (len(rows) - 1) * (len(columns) - 1)
    total = 0.0
    for a in rows:
        for b in columns:
            expected = rows[a] * columns[b] / n
            gap = abs(cells[a, b] - expected)
            if dof == 1:
                gap = max(gap - 0.5, 0.0)
            total += gap * gap / expected
    return total, dof


@pytest.fixture(scope="module")
def levels(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        two = "p" if rng.random() < 0.4 else "q"
        many = rng.choice("wxyz") if i % 3 else "w"  # one level holds more than a third
        y = int(rng.random() < (0.3 if two == "p" else 0.45))
        rows.append((i, two, None if i % 50 == 0 else many, "only", float(i % 17), 4.0, y))
    return rows, spark.createDataFrame(
        rows, "id long, two string, many string, single string, num double, flat double, y int"
    ).cache()


def test_chi_square_matches_brute_force(levels):
    rows, df = levels
    got = {r.treatment: r for r in E.chi_square(df, ["two", "many", "single"], "y").collect()}
    for name, i in (("two", 1), ("many", 2)):
        chi2, dof = brute_chi_square([(r[i], r[6]) for r in rows if r[i] is not None])
        assert got[name].chi2 == pytest.approx(chi2, rel=1e-9) and got[name].dof == dof
    assert got["single"].chi2 is None and got["single"].significant is False
    one_outcome = E.chi_square(df.withColumn("y", F.lit(1)), ["two"], "y").first()
    assert one_outcome.p_value is None and not one_outcome.significant


def test_general_independence_test_matches_brute_force(levels):
    rows, df = levels
    for a, b, i, j in (("two", "many", 1, 2), ("many", "two", 2, 1)):
        pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        got = E.independence_test(df, a, b).first()
        chi2, dof = brute_chi_square(pairs)
        assert got.chi2 == pytest.approx(chi2, rel=1e-9) and got.dof == dof
    two = E.independence_test(df.withColumn("label", F.col("y").cast("string")), "two", "label").first()
    assert two.chi2 == pytest.approx(brute_chi_square([(r[1], r[6]) for r in rows])[0], rel=1e-9)
    assert E.independence_test(df, "two", "single").first().p_value is None


def test_overall_rate_includes_rows_without_a_level(levels):
    rows, df = levels
    got = E.level_effects(df, ["many"], "y").collect()
    overall = sum(r[6] for r in rows) / len(rows)
    assert {r.level for r in got} == set("wxyz")
    for r in got:
        part = [x[6] for x in rows if x[2] == r.level]
        assert r.sample_size == len(part)
        assert r.churn_rate == pytest.approx(round(sum(part) / len(part), 4), abs=1e-9)
        assert r.effect_size == pytest.approx(r.churn_rate - overall)


def test_one_scan_and_shuffle_of_rows_for_all_text_treatments(spark):
    # On files; Spark does not share stages above an in-memory table.
    customers = spark.read.parquet(f"{SMALL}/customer.parquet").selectExpr(
        "c_mktsegment AS a", "cast(c_nationkey AS string) AS b", "int(c_acctbal > 2000) AS y"
    )
    table = E._level_effects_from(E.level_outcomes(customers, ["a", "b"], "y"))
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_dispatch_and_missing_columns(levels):
    _, df = levels
    assert E.analyze_treatment(df, "absent", "y") is None
    assert "level" in E.analyze_treatment(df, "two", "y").columns
    assert "correlation" in E.analyze_treatment(df, "num", "y").columns
    assert E.treatment_kinds(df, ["two", "absent", "num"]) == (["two"], ["num"])
    with pytest.raises(ValueError):
        E.effect_summary(df, ["absent"], "y")


def test_effect_summary_shape(levels):
    _, df = levels
    rows = E.effect_summary(df, ["two", "many", "num", "flat"], "y").collect()
    assert len(rows) == 2 + 4 + 1 + 1
    number = next(r for r in rows if r.Treatment == "num")
    assert number.Category == "Numerical" and number.P_Value is None and number.Sample_Size == 600
    assert number.R_Squared == pytest.approx(number.Correlation**2)
    flat = next(r for r in rows if r.Treatment == "flat")
    assert flat.Correlation is None and flat.Significant is False


def test_top_effects_keep_ties(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", -0.9), ("c", 0.3), ("d", 0.3), ("e", None)], "Treatment string, Effect_Size double")
    assert {r.Treatment for r in E.top_effects(df, 2).collect()} == {"a", "c", "d"}
    assert {r.Treatment for r in E.top_effects(df, 2, by="abs").collect()} == {"a", "b"}
    assert E.strongest(df, "Effect_Size", "Treatment").first().Treatment == "b"


def test_anova_matches_brute_force(levels):
    rows, df = levels
    got = {r.feature: r for r in E.anova(df, ["num", "flat"], "y").collect()}
    groups = [[r[4] for r in rows if r[6] == y] for y in (0, 1)]
    everything = groups[0] + groups[1]
    grand = sum(everything) / len(everything)
    means = [sum(g) / len(g) for g in groups]
    between = sum(len(g) * (m - grand) ** 2 for g, m in zip(groups, means))
    within = sum((x - m) ** 2 for g, m in zip(groups, means) for x in g)
    assert got["num"].score == pytest.approx(between / (within / (len(everything) - 2)), rel=1e-9)
    assert 0 < got["num"].p_value < 1
    assert got["flat"].score is None and got["flat"].p_value is None


def test_planted_effect_is_recovered_by_adjustment_only(planted):
    raw = A.stratified_effect(planted, "t", "y", []).first()
    adjusted = A.stratified_effect(planted, "t", "y", ["c"]).first()
    assert raw.Estimated_Effect == pytest.approx(0.3055, abs=1e-3)
    assert adjusted.Estimated_Effect == pytest.approx(0.1549, abs=1e-3)
    assert adjusted.CI_Lower < 0.15 < adjusted.CI_Upper and adjusted.Significant
    assert adjusted.rows_used == adjusted.rows_total == 20_000


def test_all_methods_agree_on_the_planted_effect(planted):
    got = {r.Method: r for r in A.analyze_treatment_effect(planted, "t", "y", ["c"]).collect()}
    assert got["unadjusted"].Estimated_Effect > 0.28
    for method in ("stratified", "weighted", "matched"):
        assert got[method].Estimated_Effect == pytest.approx(0.15, abs=0.02), method
        assert got[method].Significant
    with pytest.raises(ValueError):
        A.analyze_treatment_effect(planted, "t", "y", ["c"], ["guess"])


def test_strata_without_both_arms_are_left_out(spark):
    rows = [("a", 1, 1), ("a", 0, 0), ("b", 1, 1), ("b", 1, 0)]
    got = A.stratified_effect(spark.createDataFrame(rows, "s string, t int, y int"), "t", "y", ["s"]).first()
    assert (got.rows_used, got.rows_total, got.strata_used) == (2, 4, 1)
    assert got.Estimated_Effect == 1.0


def test_nearest_controls_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        # A third of all rows share one score; the rest are spread and clustered.
        score = 0.4 if i % 3 == 0 else round(rng.choice([rng.random(), 0.9 + rng.random() / 20]), 3)
        rows.append((i, score, int(rng.random() < 0.3), int(rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "id long, propensity double, t int, y int")
    controls = [(s, y) for _, s, t, y in rows if t == 0]
    expected = {}
    for s in {s for _, s, t, _ in rows if t == 1}:
        gap = min(abs(s - c) for c, _ in controls)
        if gap <= 0.05:
            near = [y for c, y in controls if abs(abs(s - c) - gap) < 1e-12]
            expected[s] = (gap, len(near), sum(near) / len(near))
    got = {r.score: r for r in A.nearest_controls(df, "t", "y").collect()}
    assert set(got) == set(expected)
    for s, (gap, n, mean) in expected.items():
        assert got[s].distance == pytest.approx(gap, abs=1e-12)
        if got[s].controls == n:  # equal distances on both sides differ in the last bit
            assert got[s].control_mean == pytest.approx(mean)
    same = sum(got[s].controls == n for s, (_, n, _) in expected.items())
    assert same >= len(expected) * 0.9
    matched = A.match_treated(df, "id", "t", "y").collect()
    treated = [r for r in rows if r[2] == 1 and r[1] in expected]
    assert sorted(r.id for r in matched) == sorted(r[0] for r in treated)


def test_caliper_without_partner_leaves_rows_out(spark):
    df = spark.createDataFrame([(0.1, 1, 1), (0.9, 0, 0)], "propensity double, t int, y int")
    assert A.nearest_controls(df, "t", "y").count() == 0
    assert A.nearest_controls(df, "t", "y", caliper=1.0).first().controls == 1


def _matched_by_hand(rows):
    """Effect and variance of nearest-score matching with replacement, row by row; rows are (score, t, y)."""
    controls = [(s, y) for s, t, y in rows if t == 0]
    uses, squares = [0.0] * len(controls), [0.0] * len(controls)
    gaps = []
    for s, t, y in rows:
        if t == 1:
            near = min(abs(s - c) for c, _ in controls)
            chosen = [i for i, (c, _) in enumerate(controls) if abs(s - c) == near]
            gaps.append(y - sum(controls[i][1] for i in chosen) / len(chosen))
            for i in chosen:
                uses[i] += 1 / len(chosen)
                squares[i] += 1 / len(chosen) ** 2
    effect = sum(gaps) / len(gaps)
    total = sum((g - effect) ** 2 for g in gaps)
    at = {}
    for s, y in controls:
        at.setdefault(s, []).append(y)
    scores = sorted(at)
    for i, (s, y) in enumerate(controls):
        same = at[s]
        if len(same) > 1:
            mean = sum(same) / len(same)
            variance = sum((x - mean) ** 2 for x in same) / (len(same) - 1)
        else:
            place = scores.index(s)
            around = scores[max(0, place - 1) : place] + scores[place + 1 : place + 2]
            other = at[min(around, key=lambda c: (abs(c - s), c))]
            variance = (y - sum(other) / len(other)) ** 2 / (1 + 1 / len(other))
        total += (uses[i] ** 2 - squares[i]) * variance
    # Treated rows of one score enter the library by their mean and sample variance: the same sum of squares.
    return effect, total / len(gaps) ** 2


def _few_controls(rng, n, grid=None):
    """Draws with a true effect of 0.15 in which controls are rare and stand for many treated rows."""
    rows = []
    for _ in range(n):
        score = rng.random() if grid is None else rng.randrange(grid) / grid
        t = int(rng.random() < 0.8)
        rows.append((score, t, 0.15 * t + score + rng.gauss(0, 0.5)))
    return rows


def test_matched_variance_counts_every_use_of_a_control(spark):
    rng = random.Random(11)
    # Scores on a grid of binary fractions: distances on both sides are equal to the last bit.
    for rows in (_few_controls(rng, 300), _few_controls(rng, 300, 64), _few_controls(rng, 300, 4)):
        effect, variance = _matched_by_hand(rows)
        got = A.matched_effect(spark.createDataFrame(rows, "propensity double, t int, y double"), "t", "y", caliper=1.0).first()
        assert got.rows_used == sum(t for _, t, _ in rows)
        assert got.Estimated_Effect == pytest.approx(effect, abs=1e-9)
        assert (got.CI_Upper - got.Estimated_Effect) / A.Z_95 == pytest.approx(variance**0.5, rel=1e-6)


def test_matched_interval_covers_the_effect():
    rng = random.Random(3)
    for grid in (None, 8):
        draws = [_matched_by_hand(_few_controls(rng, 150, grid)) for _ in range(300)]
        covered = sum(abs(effect - 0.15) <= A.Z_95 * variance**0.5 for effect, variance in draws) / len(draws)
        assert 0.90 <= covered <= 0.99


def test_matching_with_one_control_has_no_interval(spark):
    df = spark.createDataFrame([(0.5, 1, 1.0), (0.5, 1, 0.0), (0.5, 0, 0.0)], "propensity double, t int, y double")
    got = A.matched_effect(df, "t", "y").first()
    assert (got.Estimated_Effect, got.CI_Lower, got.Significant) == (0.5, None, False)


def test_refuters(planted):
    placebo = A.placebo_effect(planted, "t", "y", ["c"], "id").first()
    assert abs(placebo.Estimated_Effect) < 0.03
    subsets = A.subset_effects(planted, "t", "y", ["c"], "id", 4)
    assert sorted(r.subset for r in subsets.collect()) == [0, 1, 2, 3]
    assert subsets.agg(F.sum("rows_used")).first()[0] == 20_000
    stable = A.stability(subsets, limit=0.2).first()
    assert stable.scenarios == 4 and stable.robust
    by_strength = {r.strength: r.Estimated_Effect for r in A.confounder_sensitivity(planted, "t", "y", ["c"], "id").collect()}
    assert by_strength[0.0] == pytest.approx(0.155, abs=0.02)
    assert by_strength[1.0] < by_strength[0.5] < by_strength[0.0]


def test_binning_and_positivity(planted):
    binned, strata = A.bin_confounders(planted.withColumn("x", F.col("id") * 1.0).withColumn("s", F.lit("a")), ["x", "s"], 4)
    assert strata == ["x_bin", "s"]
    sizes = [r["count"] for r in binned.groupBy("x_bin").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    rows = A.positivity(planted, "t", ["c"]).collect()
    assert all(r.positive and r.levels_present == 2 for r in rows)


def test_policy_scenarios(spark, cleaned):
    scenarios = spark.createDataFrame([(50.0, 40.0, 10.0), (50.0, 50.0, 10.0)], "current_percent double, target_percent double, incentive_cost double")
    a, b = sorted(A.policy_scenarios(cleaned, "Churn", scenarios).collect(), key=lambda r: r.target_percent)
    assert a.new_churn == pytest.approx(a.baseline_churn * 0.985)
    assert a.total_cost == pytest.approx(a.customers * 1.0) and a.roi is not None
    assert b.roi is None and b.recommended is False


def test_one_row_arms_take_the_pooled_variance(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("a", 0, 0.0), ("a", 0, 4.0), ("b", 1, 5.0), ("b", 0, 1.0), ("b", 0, 3.0)]
    got = A.stratified_effect(spark.createDataFrame(rows, "s string, t int, y double"), "t", "y", ["s"]).first()
    # Variances 2, 8 and 2 with one degree of freedom each pool to 4, which the single row of b takes.
    variance = (16 * (2 / 2 + 8 / 2) + 9 * (4 / 1 + 2 / 2)) / 49
    assert got.rows_used == 7 and got.Estimated_Effect == pytest.approx((4 * 0 + 3 * 3) / 7)
    assert got.CI_Upper - got.Estimated_Effect == pytest.approx(1.959964 * variance**0.5, rel=1e-5)
    single = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 0.0)], "s string, t int, y double")
    got = A.stratified_effect(single, "t", "y", ["s"]).first()
    assert got.Estimated_Effect == 1.0 and got.P_Value is None and got.Significant is False

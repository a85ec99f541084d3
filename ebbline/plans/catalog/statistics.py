"""Queries: tests, effect tables and adjusted effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.config import ROLES
from ebbline.operators import adjust as A
from ebbline.operators import effects as E
from ebbline.operators import features as X
from ebbline.plans.catalog.cleaning import BAND
from ebbline.plans.catalog.profiling import NUMERIC, union
from ebbline.plans.catalog.registry import query, r6

Z = "1.959963984540054e0"


def normal_p(z):
    """SQL text: two-sided normal tail of ``z`` by the power series of the error function."""
    x = f"GREATEST(ABS({z})/SQRT(2e0), 1e-12)"
    return (
        f"CASE WHEN ABS({z})>8 THEN 0e0 ELSE 1-EXP(-POWER({x},2))*LIST_SUM(LIST_TRANSFORM(RANGE(0,200), "
        f"lambda n: EXP((2*n+1)*LN({x})-LGAMMA(n+1.5e0)))) END"
    )


def chi2_p(x, dof):
    """SQL text: chi-square tail for 1, 2, 3 or 4 degrees of freedom."""
    return (
        f"CASE {dof} WHEN 2 THEN EXP(-{x}/2) WHEN 4 THEN EXP(-{x}/2)*(1+{x}/2) "
        f"WHEN 1 THEN {normal_p(f'SQRT({x})')} "
        f"WHEN 3 THEN {normal_p(f'SQRT({x})')} + SQRT(2*{x}/PI())*EXP(-{x}/2) END"
    )


def chi_square_ctes(levels):
    """CTEs ending in ``chi(treatment, chi2, dof)`` for text columns against the label."""
    source = union(f"""SELECT '{name}' AS t, {column} AS lvl, "Churn" AS y FROM cl""" for name, column in levels)
    return f"""src AS ({source}), known AS (SELECT * FROM src WHERE lvl IS NOT NULL AND y IS NOT NULL),
    o AS (SELECT t, lvl, y, COUNT(*) AS n FROM known GROUP BY t, lvl, y),
    g AS (SELECT l.t, l.lvl, v.y, COALESCE(o.n,0)*1e0 AS n
      FROM (SELECT DISTINCT t, lvl FROM known) l JOIN (SELECT DISTINCT t, y FROM known) v ON l.t=v.t
      LEFT JOIN o ON o.t=l.t AND o.lvl=l.lvl AND o.y=v.y),
    e AS (SELECT *, SUM(n) OVER (PARTITION BY t, lvl)*SUM(n) OVER (PARTITION BY t, y)/SUM(n) OVER (PARTITION BY t) AS ex FROM g),
    k AS (SELECT t, (COUNT(DISTINCT lvl)-1)*(COUNT(DISTINCT y)-1) AS dof FROM e GROUP BY t),
    chi AS (SELECT e.t AS treatment, SUM(POWER(CASE WHEN dof=1 THEN GREATEST(ABS(n-ex)-0.5e0,0e0) ELSE ABS(n-ex) END,2)/ex) AS chi2,
      CAST(MAX(dof) AS BIGINT) AS dof FROM e JOIN k ON e.t=k.t GROUP BY e.t)"""


TEXT_LEVELS = [(c, f'"{c}"') for c in ("Contract", "PaymentMethod", "InternetService", "Partner", "Dependents")]
CHI_SELECT = f"""SELECT treatment, {r6('chi2', 'chi2')}, dof, {r6(chi2_p('chi2', 'dof'), 'p_value')},
    {chi2_p('chi2', 'dof')}<0.05e0 AS significant FROM chi"""


@query("t01_chi_square", chi_square_ctes(TEXT_LEVELS) + " " + CHI_SELECT)
def _(t):
    return E.chi_square(t.clean, [name for name, _ in TEXT_LEVELS], "Churn")


@query(
    "t01b_independence_of_two_columns",
    f"""o AS (SELECT "Contract" AS a, "InternetService" AS b, COUNT(*)*1e0 AS n FROM cl GROUP BY 1,2),
    e AS (SELECT *, SUM(n) OVER (PARTITION BY a)*SUM(n) OVER (PARTITION BY b)/SUM(n) OVER () AS ex FROM o),
    chi AS (SELECT SUM(POWER(n-ex,2)/ex) AS chi2, CAST((COUNT(DISTINCT a)-1)*(COUNT(DISTINCT b)-1) AS BIGINT) AS dof FROM e)
    SELECT {r6('chi2', 'chi2')}, dof, {r6(chi2_p('chi2', 'dof'), 'p_value')}, {chi2_p('chi2', 'dof')}<0.05e0 AS significant FROM chi""",
)
def _(t):
    return E.independence_test(t.clean, "Contract", "InternetService")


@query(
    "t02_guarded_chi_square",
    chi_square_ctes([("Contract", '"Contract"'), ("tenure_group", BAND)])
    + " " + CHI_SELECT + " UNION ALL SELECT 'one_level', NULL, NULL, NULL, FALSE",
)
def _(t):
    data = t.clean.withColumns({"tenure_group": X.tenure_band(), "one_level": F.lit("same")})
    return E.chi_square(data, ["Contract", "tenure_group", "one_level"], "Churn")


@query(
    "t03_pearson_r",
    union(f"""SELECT '{c}' AS treatment, {r6(f'CORR("{c}", "Churn")', 'correlation')} FROM cl""" for c in NUMERIC),
)
def _(t):
    return E.numeric_effects(t.clean, NUMERIC, "Churn").select("treatment", "correlation")


@query(
    "t04_linear_regression",
    union(
        f"""SELECT '{c}' AS treatment, {r6(f'CORR("{c}", "Churn")', 'correlation')},
        {r6(f'REGR_SLOPE("Churn", "{c}")', 'regression_coefficient')}, {r6(f'REGR_R2("Churn", "{c}")', 'r_squared')},
        COUNT(*) AS sample_size FROM cl"""
        for c in NUMERIC
    ),
)
def _(t):
    return E.numeric_effects(t.clean, NUMERIC, "Churn")


def _anova(c):
    return f"""SELECT '{c}' AS feature, SUM(n*POWER(m-grand,2))/(COUNT(*)-1)/(SUM(n*v)/(SUM(n)-COUNT(*))) AS f, SUM(n)-COUNT(*) AS d2 FROM (
      SELECT COUNT(*) AS n, AVG("{c}") AS m, VAR_POP("{c}") AS v, MAX((SELECT AVG("{c}") FROM cl)) AS grand FROM cl GROUP BY "Churn")"""


# With two classes F is a squared t: its tail is integrated by Simpson's rule.
STUDENT_P = """1-2*EXP(LGAMMA((d2+1)/2e0)-LGAMMA(d2/2e0))/SQRT(d2*PI())*SQRT(f)/2000/3*LIST_SUM(LIST_TRANSFORM(RANGE(0,2001),
    lambda i: (CASE WHEN i=0 OR i=2000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*POWER(1+f*POWER(i/2000e0,2)/d2, -(d2+1)/2e0)))"""


@query(
    "t05_anova",
    "a AS (" + union(_anova(c) for c in NUMERIC) + f") SELECT feature, {r6('f', 'score')}, {r6(STUDENT_P, 'p_value')} FROM a",
)
def _(t):
    return E.select_k_best(E.anova(t.clean, NUMERIC, "Churn"), 20)


@query(
    "t06_dispatch_by_type",
    f"""o AS (SELECT AVG("Churn") AS overall FROM cl)
    SELECT 'SeniorCitizen' AS treatment, "SeniorCitizen" AS level, CAST(ROUND_EVEN(AVG("Churn"),4) AS DOUBLE) AS churn_rate,
    {r6('MAX(overall)', 'overall_churn_rate')}, {r6('CAST(ROUND_EVEN(AVG("Churn"),4) AS DOUBLE)-MAX(overall)', 'effect_size')},
    {r6('(CAST(ROUND_EVEN(AVG("Churn"),4) AS DOUBLE)-MAX(overall))/MAX(overall)', 'relative_effect')}, COUNT("Churn") AS sample_size
    FROM cl CROSS JOIN o GROUP BY "SeniorCitizen" """,
)
def _(t):
    # Cleaning turned the flag into text, so it is handled as levels.
    return E.analyze_treatment(t.clean, "SeniorCitizen", "Churn")


TREATMENT_ROWS = "u AS (" + union(
    f"""SELECT '{c}' AS treatment, "{c}" AS level, AVG("Churn") AS raw, CAST(ROUND_EVEN(AVG("Churn"),4) AS DOUBLE) AS rate,
    COUNT("Churn") AS n, (SELECT AVG("Churn") FROM cl) AS overall FROM cl GROUP BY 2"""
    for c in ROLES.treatments
) + ")"


@query(
    "t07_all_treatments",
    TREATMENT_ROWS + f""" SELECT treatment, level, rate AS churn_rate, {r6('overall', 'overall_churn_rate')},
    {r6('rate-overall', 'effect_size')}, {r6('(rate-overall)/overall', 'relative_effect')}, n AS sample_size FROM u""",
)
def _(t):
    text, _ = E.treatment_kinds(t.clean, [*ROLES.treatments, "NotThere"])
    return E.level_effects(t.clean, text, "Churn")


SUMMARY_TREATMENTS = [*ROLES.treatments, "tenure", "MonthlyCharges"]
SUMMARY = (
    chi_square_ctes(TEXT_LEVELS[:3]) + ", " + TREATMENT_ROWS + f""", eff AS (
    SELECT u.treatment AS "Treatment", level AS "Category", rate AS "Churn_Rate", overall AS "Overall_Churn_Rate",
      rate-overall AS "Effect_Size", (rate-overall)/overall*100 AS "Relative_Effect_Percent", n AS "Sample_Size",
      {chi2_p('chi2', 'dof')} AS "P_Value", {chi2_p('chi2', 'dof')}<0.05e0 AS "Significant",
      CAST(NULL AS DOUBLE) AS "Correlation", CAST(NULL AS DOUBLE) AS "Regression_Coefficient", CAST(NULL AS DOUBLE) AS "R_Squared"
      FROM u JOIN chi ON u.treatment=chi.treatment
    """ + "".join(
        f""" UNION ALL SELECT '{c}', 'Numerical', NULL, NULL, CORR("{c}","Churn"), ABS(CORR("{c}","Churn"))*100, COUNT(*), NULL,
        ABS(CORR("{c}","Churn"))>0.1e0, CORR("{c}","Churn"), REGR_SLOPE("Churn","{c}"), REGR_R2("Churn","{c}") FROM cl"""
        for c in ("tenure", "MonthlyCharges")
    ) + ")"
)
SUMMARY_SELECT = "SELECT " + ", ".join(
    f'"{c}"' if c in ("Treatment", "Category", "Sample_Size", "Significant") else r6(f'"{c}"', f'"{c}"')
    for c in (
        "Treatment", "Category", "Churn_Rate", "Overall_Churn_Rate", "Effect_Size", "Relative_Effect_Percent",
        "Sample_Size", "P_Value", "Significant", "Correlation", "Regression_Coefficient", "R_Squared",
    )
)


@query("t08_effect_summary", SUMMARY + " " + SUMMARY_SELECT + " FROM eff")
def _(t):
    return E.effect_summary(t.clean, SUMMARY_TREATMENTS)


SIMPLE = TREATMENT_ROWS + f""" SELECT treatment AS "Treatment_Variable", level AS "Treatment_Level", {r6('raw', '"Churn_Rate"')},
    {r6('overall', '"Base_Churn_Rate"')}, {r6('raw-overall', '"Effect_Size"')}, {r6('(raw-overall)/overall', '"Relative_Effect"')},
    CAST(NULL AS DOUBLE) AS "Correlation_with_Churn", CAST(NULL AS VARCHAR) AS "Analysis_Type" FROM u
    UNION ALL SELECT 'tenure', 'Numerical', NULL, NULL, NULL, NULL, ROUND(CORR(tenure,"Churn"),6), 'Correlation' FROM cl"""


@query("t09_simple_effects", SIMPLE)
def _(t):
    return E.simple_effects(t.clean, [*ROLES.treatments, "tenure"])


@query("u01_union_of_unlike_rows", SIMPLE)
def _(t):
    levels = E.simple_effects(t.clean, ROLES.treatments).drop("Correlation_with_Churn", "Analysis_Type")
    numbers = E.simple_effects(t.clean, ["tenure"]).select(
        "Treatment_Variable", "Treatment_Level", "Correlation_with_Churn", "Analysis_Type"
    )
    return levels.unionByName(numbers, allowMissingColumns=True)


@query(
    "t10_top_effects_with_ties",
    SUMMARY + """, r AS (SELECT *, RANK() OVER (ORDER BY "Effect_Size" DESC) AS k FROM eff) """ + SUMMARY_SELECT + " FROM r WHERE k<=5",
)
def _(t):
    return E.top_effects(E.effect_summary(t.clean, SUMMARY_TREATMENTS), 5)


@query(
    "k04_top_absolute_effects",
    SUMMARY + """, r AS (SELECT *, RANK() OVER (ORDER BY ABS("Effect_Size") DESC) AS k FROM eff) """ + SUMMARY_SELECT + " FROM r WHERE k<=5",
)
def _(t):
    return E.top_effects(E.effect_summary(t.clean, SUMMARY_TREATMENTS), 5, by="abs")


@query(
    "c28_strongest_effect",
    SUMMARY + f""" SELECT "Treatment", "Category", {r6('"Effect_Size"', '"Effect_Size"')} FROM eff ORDER BY ABS("Effect_Size") DESC, 1, 2 LIMIT 1""",
)
def _(t):
    return E.strongest(E.effect_summary(t.clean, SUMMARY_TREATMENTS), "Effect_Size", "Treatment", "Category")


CONTRASTS = f"""g AS (SELECT "Contract" AS lvl, COUNT(*)*1e0 AS n, AVG("Churn") AS m, VAR_SAMP("Churn") AS v FROM cl GROUP BY 1),
    d AS (SELECT g.lvl, g.m-b.m AS eff, SQRT(g.v/g.n+b.v/b.n) AS se, CAST(g.n+b.n AS BIGINT) AS rows_used FROM g CROSS JOIN
      (SELECT * FROM g WHERE lvl='Two year') b WHERE g.lvl<>'Two year'),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)"""
EFFECT_COLUMNS = f"""{r6('eff', '"Estimated_Effect"')}, {r6(f'eff-{Z}*se', '"CI_Lower"')}, {r6(f'eff+{Z}*se', '"CI_Upper"')},
    {r6('p', '"P_Value"')}, p<0.05e0 AS "Significant" """


@query(
    "e05_level_contrasts",
    CONTRASTS + f""" SELECT 'Contract' AS "Treatment", lvl AS "Level", 'Two year' AS "Reference", {EFFECT_COLUMNS}, rows_used FROM dd""",
)
def _(t):
    return A.level_contrasts(t.clean, "Contract", "Churn", "Two year")


ADJUSTED = f"""g AS (SELECT {BAND} AS s1, "Partner" AS s2, "Contract" AS lvl, COUNT(*)*1e0 AS n, AVG("Churn") AS m,
      VAR_SAMP("Churn") AS v FROM cl WHERE {BAND} IS NOT NULL GROUP BY 1,2,3),
    j AS (SELECT g.lvl, g.n AS n1, g.m AS m1, g.v AS v1, b.n AS n0, b.m AS m0, b.v AS v0
      FROM g JOIN g b ON g.s1=b.s1 AND g.s2=b.s2 AND b.lvl='Two year' WHERE g.lvl<>'Two year'),
    po AS (SELECT lvl, SUM(COALESCE((n1-1)*v1,0)+COALESCE((n0-1)*v0,0))/NULLIF(SUM(n1+n0-2),0) AS pooled FROM j GROUP BY lvl),
    d AS (SELECT j.lvl, SUM((n1+n0)*(m1-m0))/SUM(n1+n0) AS eff,
      SQRT(SUM(POWER(n1+n0,2)*(COALESCE(v1,pooled)/n1+COALESCE(v0,pooled)/n0))/POWER(SUM(n1+n0),2)) AS se,
      CAST(SUM(n1+n0) AS BIGINT) AS rows_used FROM j JOIN po ON j.lvl=po.lvl GROUP BY j.lvl),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)"""


@query(
    "e05b_adjusted_level_contrasts",
    ADJUSTED + f""" SELECT 'Contract' AS "Treatment", lvl AS "Level", 'Two year' AS "Reference", {EFFECT_COLUMNS}, rows_used FROM dd""",
)
def _(t):
    banded = t.clean.withColumn("tenure_group", X.tenure_band())
    return A.level_contrasts(banded, "Contract", "Churn", "Two year", ["tenure_group", "Partner"])


def _with_partner(t):
    return t.clean.withColumn("t", (F.col("Partner") == "Yes").cast("int"))


ARMS = """s AS (SELECT c, COUNT(*)*1e0 AS n, COUNT(*) FILTER (t=1)*1e0 AS n1, COUNT(*) FILTER (t=0)*1e0 AS n0, AVG(y) FILTER (t=1) AS m1,
      AVG(y) FILTER (t=0) AS m0, VAR_SAMP(y) FILTER (t=1) AS v1, VAR_SAMP(y) FILTER (t=0) AS v0 FROM pl GROUP BY c)"""
UNADJUSTED = """AVG(y) FILTER (t=1)-AVG(y) FILTER (t=0) AS eff,
      SQRT(VAR_SAMP(y) FILTER (t=1)/COUNT(*) FILTER (t=1)+VAR_SAMP(y) FILTER (t=0)/COUNT(*) FILTER (t=0)) AS se FROM pl"""
# One 0/1 confounder gives two scores, so the nearest controls are those of the same stratum: each stands for n1/n0 treated
# rows, the sum of n1 weights of 1/n0.
MATCHED = """SUM(n1*(m1-m0))/SUM(n1) AS eff,
      SQRT(SUM(n1*POWER(m1-m0,2))-POWER(SUM(n1*(m1-m0)),2)/SUM(n1)+SUM((n1-1)*v1)+SUM(n0*(POWER(n1/n0,2)-n1/(n0*n0))*v0))/SUM(n1)
      AS se FROM s"""


@query(
    "e01_effect_by_method",
    ARMS + f""", d AS (SELECT 'unadjusted' AS method, {UNADJUSTED}
      UNION ALL SELECT 'stratified', SUM(n*(m1-m0))/SUM(n), SQRT(SUM(n*n*(v1/n1+v0/n0)))/SUM(n) FROM s
      UNION ALL SELECT 'matched', {MATCHED}),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)
    SELECT 't' AS "Treatment", method AS "Method", {EFFECT_COLUMNS} FROM dd""",
)
def _(t):
    methods = ("unadjusted", "stratified", "matched")
    return A.analyze_treatment_effect(t.planted, "t", "y", ["c"], methods)


@query("e01c_weighted_by_model")
def _(t):
    return A.analyze_treatment_effect(t.planted, "t", "y", ["c"], ("weighted",))


@query("e01b_effect_on_customers")
def _(t):
    return A.analyze_treatment_effect(
        _with_partner(t), "t", "Churn", ["tenure", "MonthlyCharges", "SeniorCitizen"]
    )


@query(
    "e02_propensity_score",
    # With one 0/1 confounder the logistic model reproduces the treated share per level.
    """SELECT CAST(c AS INT) AS c, ROUND(AVG(t), 3) + 0e0 AS propensity, COUNT(*) AS n FROM pl GROUP BY c""",
)
def _(t):
    scored = A.with_propensity(t.planted, "t", ["c"])
    return scored.groupBy("c").agg(
        F.round(F.avg("propensity"), 3).alias("propensity"), F.count(F.lit(1)).alias("n")
    )


NEAREST = """ts AS (SELECT tenure AS s, COUNT(*) AS n1, AVG("Churn") AS m1 FROM cl WHERE "Partner"='Yes' GROUP BY 1),
    cs AS (SELECT tenure AS s, COUNT(*) AS n0, SUM("Churn") AS y0 FROM cl WHERE "Partner"='No' GROUP BY 1),
    d AS (SELECT ts.s, n1, m1, cs.s AS c, n0, y0, ABS(ts.s-cs.s) AS gap, MIN(ABS(ts.s-cs.s)) OVER (PARTITION BY ts.s) AS best
      FROM ts CROSS JOIN cs)"""


@query(
    "e03_nearest_controls",
    NEAREST + f""" SELECT {r6('s/100e0', 'score')}, n1 AS treated, {r6('MAX(m1)', 'treated_mean')}, {r6('MAX(best)/100e0', 'distance')},
    CAST(SUM(n0) AS BIGINT) AS controls, {r6('SUM(y0)*1e0/SUM(n0)', 'control_mean')} FROM d WHERE gap=best AND best<=5 GROUP BY s, n1""",
)
def _(t):
    # Tenure takes the place of the score, so that plain SQL can find the nearest controls too.
    scored = _with_partner(t).withColumn("score", F.round(F.col("tenure") / 100, 2))
    return A.nearest_controls(scored, "t", "Churn", "score", caliper=0.05).select(
        "score", "treated", "treated_mean", "distance", "controls", "control_mean"
    )


@query(
    "e03b_matched_effect",
    ARMS + f""", d AS (SELECT CAST(SUM(n1) AS BIGINT) AS rows_used, {MATCHED}),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)
    SELECT {EFFECT_COLUMNS}, rows_used, 0e0 AS mean_distance FROM dd""",
)
def _(t):
    return A.matched_effect(A.with_propensity(t.planted, "t", ["c"]), "t", "y")


@query("e03c_matched_rows")
def _(t):
    scored = A.with_propensity(_with_partner(t), "t", ["tenure", "MonthlyCharges"])
    return A.match_treated(scored, "customerID", "t", "Churn")


STRATIFIED = f"""s AS (SELECT c, COUNT(*)*1e0 AS n, COUNT(*) FILTER (t=1) AS n1, COUNT(*) FILTER (t=0) AS n0, AVG(y) FILTER (t=1) AS m1,
      AVG(y) FILTER (t=0) AS m0, VAR_SAMP(y) FILTER (t=1) AS v1, VAR_SAMP(y) FILTER (t=0) AS v0 FROM pl GROUP BY c),
    d AS (SELECT SUM(n*(m1-m0))/SUM(n) AS eff, SQRT(SUM(n*n*(v1/n1+v0/n0)))/SUM(n) AS se, COUNT(*) AS strata_used,
      CAST(SUM(n) AS BIGINT) AS rows_used, CAST(SUM(n) AS BIGINT) AS rows_total FROM s WHERE n1>0 AND n0>0),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)"""


@query("e04_stratified_effect", STRATIFIED + f" SELECT {EFFECT_COLUMNS}, strata_used, rows_used, rows_total FROM dd")
def _(t):
    return A.stratified_effect(t.planted, "t", "y", ["c"])


@query(
    "e04b_unadjusted_effect",
    f"""d AS (SELECT AVG(y) FILTER (t=1)-AVG(y) FILTER (t=0) AS eff,
      SQRT(VAR_SAMP(y) FILTER (t=1)/COUNT(*) FILTER (t=1)+VAR_SAMP(y) FILTER (t=0)/COUNT(*) FILTER (t=0)) AS se,
      CAST(1 AS BIGINT) AS strata_used, COUNT(*) AS rows_used, COUNT(*) AS rows_total FROM pl),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d)
    SELECT {EFFECT_COLUMNS}, strata_used, rows_used, rows_total FROM dd""",
)
def _(t):
    return A.stratified_effect(t.planted, "t", "y", [])


@query(
    "e05c_weighted_effect",
    f"""ps AS (SELECT c, AVG(t) AS p FROM pl GROUP BY c),
    w AS (SELECT y, t/p AS w1, (1-t)/(1-p) AS w0 FROM pl JOIN ps ON pl.c=ps.c),
    m AS (SELECT SUM(w1*y)/SUM(w1) AS m1, SUM(w0*y)/SUM(w0) AS m0 FROM w),
    d AS (SELECT MAX(m1)-MAX(m0) AS eff, SQRT(SUM(w1*w1*POWER(y-m1,2))/POWER(SUM(w1),2)+SUM(w0*w0*POWER(y-m0,2))/POWER(SUM(w0),2)) AS se,
      COUNT(*) AS rows_used FROM w CROSS JOIN m),
    dd AS (SELECT *, {normal_p('(eff/se)')} AS p FROM d) SELECT {EFFECT_COLUMNS}, rows_used FROM dd""",
)
def _(t):
    # The score here is the treated share per confounder level, which SQL can state as well.
    shares = t.planted.groupBy("c").agg(F.avg("t").alias("propensity"))
    return A.weighted_effect(t.planted.join(shares, "c"), "t", "y")


@query("e06_placebo_treatment")
def _(t):
    return A.placebo_effect(t.planted, "t", "y", ["c"], "id")


@query("e07_subset_effects")
def _(t):
    return A.subset_effects(t.planted, "t", "y", ["c"], "id")


@query("e07b_subset_stability")
def _(t):
    return A.stability(A.subset_effects(t.planted, "t", "y", ["c"], "id"))


@query("e08_confounder_sensitivity")
def _(t):
    return A.confounder_sensitivity(t.planted, "t", "y", ["c"], "id")


SCENARIOS = [(50.0, 40.0, 10.0), (60.0, 30.0, 25.0), (50.0, 50.0, 10.0), (45.0, 25.0, 80.0)]


@query(
    "e09_policy_scenarios",
    "sn(current_percent, target_percent, incentive_cost) AS (VALUES " + ", ".join(f"({a}e0,{b}e0,{c}e0)" for a, b, c in SCENARIOS)
    + f"""), b AS (SELECT AVG("Churn") AS base, COUNT(*) AS n FROM cl),
    k AS (SELECT *, base*(1-(current_percent-target_percent)/100*0.15e0) AS new, n*(current_percent-target_percent)/100 AS moved FROM sn CROSS JOIN b),
    v AS (SELECT *, moved*incentive_cost AS cost, (base-new)*n*500 AS saved FROM k)
    SELECT current_percent, target_percent, incentive_cost, {r6('base', 'baseline_churn')}, n AS customers, {r6('new', 'new_churn')},
    {r6('moved', 'customers_affected')}, {r6('cost', 'total_cost')}, {r6('base-new', 'churn_reduction')}, {r6('saved', 'value_saved')},
    {r6('CASE WHEN cost>0 THEN (saved-cost)/cost END', 'roi')}, saved>cost AS recommended FROM v""",
)
def _(t):
    scenarios = t.spark.createDataFrame(
        SCENARIOS, "current_percent double, target_percent double, incentive_cost double"
    )
    return A.policy_scenarios(t.clean, "Churn", scenarios)


@query(
    "e10_positivity",
    f"""g AS (SELECT {BAND} AS tenure_group, "Partner", "Contract" AS c, COUNT(*) AS k FROM cl WHERE {BAND} IS NOT NULL GROUP BY 1,2,3)
    SELECT tenure_group, "Partner", CAST(SUM(k) AS BIGINT) AS n, COUNT(*) AS levels_present, (SELECT COUNT(DISTINCT c) FROM g) AS all_levels,
    COUNT(*)=(SELECT COUNT(DISTINCT c) FROM g) AS positive FROM g GROUP BY 1,2""",
)
def _(t):
    banded = t.clean.withColumn("tenure_group", X.tenure_band())
    return A.positivity(banded, "Contract", ["tenure_group", "Partner"])


@query(
    "f02_significant_effects",
    CONTRASTS.replace('"Contract"', "band").replace("FROM cl", f'FROM (SELECT {BAND} AS band, "Churn" FROM cl) WHERE band IS NOT NULL').replace("'Two year'", "'1-2yr'")
    + f""" SELECT 'band' AS "Treatment", lvl AS "Level", '1-2yr' AS "Reference", {EFFECT_COLUMNS}, rows_used FROM dd WHERE p<0.05e0""",
)
def _(t):
    contrasts = A.level_contrasts(t.clean.withColumn("band", X.tenure_band()), "band", "Churn", "1-2yr")
    return E.significant_effects(contrasts, "Estimated_Effect")


@query(
    "c29_significant_effect_summary",
    STRATIFIED
    + f""" SELECT COUNT(*) AS significant_effects, {r6('AVG(eff)', 'average_effect')}, {r6('MAX(ABS(eff))', 'strongest_effect')}
    FROM dd WHERE p<0.05e0""",
)
def _(t):
    return E.significant_effect_summary(
        A.stratified_effect(t.planted, "t", "y", ["c"]), "Estimated_Effect"
    )


@query(
    "t11_treatment_check",
    union(
        f"""SELECT '{c}' AS treatment, "{c}" AS level, COUNT(*) AS n, COUNT(*) FILTER ("Churn"=0) AS n_0,
        COUNT(*) FILTER ("Churn"=1) AS n_1, {r6('AVG("Churn")', 'churn_rate')} FROM cl GROUP BY 2"""
        for c in ROLES.treatments
    ),
)
def _(t):
    return E.treatment_check(t.clean, ROLES.treatments, "Churn")

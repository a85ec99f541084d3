"""Queries: aggregations and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.config import ROLES, raw_schema
from ebbline.functions.scalars import count_yes, direction, risk_tier, text_to_number
from ebbline.operators import clean as C
from ebbline.operators import effects as E
from ebbline.operators import features as X
from ebbline.operators import frequency as Q
from ebbline.operators import profile as P
from ebbline.plans.catalog.cleaning import BAND, BAND_REPORT, TIER
from ebbline.plans.catalog.registry import query, r6

NUMERIC = list(ROLES.numeric)
CATEGORICAL = list(ROLES.categorical)
RAW_COLUMNS = raw_schema().fieldNames()
TEXT_COLUMNS = [c for c in RAW_COLUMNS if c not in ("customerID", "SeniorCitizen", "tenure", "MonthlyCharges", "Churn")]


def union(parts):
    return "\n UNION ALL ".join(parts)


def long_sql(columns, table="f"):
    """CTE ``lv(column, value, n)``: level counts of text columns."""
    return "lv AS (" + union(
        f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS value, COUNT(*) AS n FROM {table} GROUP BY 2"""
        for c in columns
    ) + ")"


@query("c01_overall_churn_rate", f"""SELECT {r6('AVG("Churn")', 'rate')} FROM cl""")
def _(t):
    return P.overall_rate(t.clean, "Churn")


@query(
    "c02_value_counts",
    f"""SELECT "PaymentMethod", COUNT(*) AS n, {r6('COUNT(*)*1e0/SUM(COUNT(*)) OVER ()', 'share')},
    {r6('COUNT(*)*1e2/SUM(COUNT(*)) OVER ()', 'percent')} FROM cl GROUP BY 1""",
)
def _(t):
    return Q.value_counts(t.clean, "PaymentMethod")


@query(
    "c03_churn_rate_by_level",
    f"""SELECT {BAND} AS band, {r6('AVG("Churn")', 'churn_rate')} FROM cl WHERE {BAND} IS NOT NULL GROUP BY 1""",
)
def _(t):
    banded = t.clean.withColumn("band", X.tenure_band())
    return P.rate_by_level(banded, "band", "Churn").orderBy("churn_rate", "band")


@query(
    "c04_effect_by_level",
    f"""o AS (SELECT AVG("Churn") AS overall FROM cl),
    g AS (SELECT "Contract" AS level, CAST(ROUND_EVEN(AVG("Churn"), 4) AS DOUBLE) AS rate, COUNT("Churn") AS n FROM cl GROUP BY 1)
    SELECT 'Contract' AS treatment, level, rate AS churn_rate, {r6('overall', 'overall_churn_rate')},
    {r6('rate-overall', 'effect_size')}, {r6('(rate-overall)/overall', 'relative_effect')}, n AS sample_size
    FROM g CROSS JOIN o""",
)
def _(t):
    return E.level_effects(t.clean, ["Contract"], "Churn")


@query(
    "c05_treatment_profile",
    """SELECT "Contract", CAST(ROUND_EVEN(AVG("Churn"),3) AS DOUBLE) AS churn_mean, COUNT("Churn") AS churn_count,
    CAST(ROUND_EVEN(AVG(tenure),3) AS DOUBLE) AS tenure_mean, CAST(ROUND_EVEN(AVG("MonthlyCharges"),3) AS DOUBLE) AS charges_mean
    FROM cl GROUP BY 1""",
)
def _(t):
    return P.treatment_profile(t.clean, "Contract", "Churn")


@query(
    "c06_numeric_by_label",
    union(
        f"""SELECT '{c}' AS "column", "Churn", CAST(ROUND_EVEN(AVG("{c}"),2) AS DOUBLE) AS mean,
        CAST(ROUND_EVEN(MEDIAN(CAST("{c}" AS DOUBLE)),2) AS DOUBLE) AS median,
        CAST(ROUND_EVEN(STDDEV_SAMP("{c}"),2) AS DOUBLE) AS std FROM cl GROUP BY 2"""
        for c in ("tenure", "MonthlyCharges", "TotalCharges")
    ),
)
def _(t):
    return P.numeric_by_label(t.clean, NUMERIC, "Churn")


@query(
    "c07_contingency",
    """SELECT "Contract", COUNT(*) FILTER ("Churn"=0) AS n_0, COUNT(*) FILTER ("Churn"=1) AS n_1 FROM cl GROUP BY 1""",
)
def _(t):
    return P.contingency(t.clean, "Contract", "Churn")


@query(
    "c08_top_rates_by_level",
    "u AS (" + union(
        f"""SELECT '{c}' AS "column", CAST("{c}" AS VARCHAR) AS level, AVG("Churn")*100 AS p, COUNT(*) AS n FROM cl GROUP BY 2"""
        for c in CATEGORICAL[:6]
    ) + f"""), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY p DESC, level) AS place FROM u)
    SELECT "column", CAST(place AS INT) AS place, level, {r6('p', 'churn_percent')}, n FROM k WHERE place<=5""",
)
def _(t):
    return P.top_rates(t.clean, CATEGORICAL[:6], "Churn", 5)


def _describe(c):
    return f"""SELECT '{c}' AS "column", COUNT("{c}") AS "count", {r6(f'AVG("{c}")', 'mean')},
    {r6(f'STDDEV_SAMP("{c}")', 'std')}, CAST(MIN("{c}") AS DOUBLE) AS "min",
    {r6(f'QUANTILE_CONT(CAST("{c}" AS DOUBLE), 0.25)', 'q25')}, {r6(f'QUANTILE_CONT(CAST("{c}" AS DOUBLE), 0.5)', 'q50')},
    {r6(f'QUANTILE_CONT(CAST("{c}" AS DOUBLE), 0.75)', 'q75')}, CAST(MAX("{c}") AS DOUBLE) AS "max" FROM cl"""


@query("c09_describe", union(_describe(c) for c in NUMERIC))
def _(t):
    return P.describe(t.clean, NUMERIC)


# The raw table has no nulls, so null reports run on the table with blanks turned into nulls.
NUMBERED = """nf AS (SELECT * REPLACE (TRY_CAST(TRIM("TotalCharges") AS DOUBLE) AS "TotalCharges"),
 """ + BAND + """ AS tenure_group FROM f)"""


def with_nulls(t):
    return t.base.withColumns(
        {"TotalCharges": text_to_number("TotalCharges"), "tenure_group": X.tenure_band()}
    )


NULL_COLUMNS = ["customerID", "tenure", "MonthlyCharges", "TotalCharges", "tenure_group", "Churn"]


@query(
    "c10_null_counts",
    NUMBERED + union(
        f"""{'' if i else ' '}SELECT '{c}' AS "column", COUNT(*) FILTER ("{c}" IS NULL) AS null_count,
        {r6(f'COUNT(*) FILTER ("{c}" IS NULL)*1e2/COUNT(*)', 'null_percent')} FROM nf"""
        for i, c in enumerate(NULL_COLUMNS)
    ),
)
def _(t):
    return P.null_counts(with_nulls(t), NULL_COLUMNS)


@query(
    "f03_columns_with_nulls",
    NUMBERED + ", n AS (" + union(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER ("{c}" IS NULL) AS null_count,
        {r6(f'COUNT(*) FILTER ("{c}" IS NULL)*1e2/COUNT(*)', 'null_percent')} FROM nf"""
        for c in NULL_COLUMNS
    ) + ") SELECT * FROM n WHERE null_count>0",
)
def _(t):
    return P.columns_with_nulls(with_nulls(t), NULL_COLUMNS)


TYPES = {"customerID": "bigint", "SeniorCitizen": "int", "tenure": "int", "MonthlyCharges": "double"}


@query(
    "c11_column_profile",
    union(
        f"""SELECT '{c}' AS "column", '{TYPES.get(c, 'string')}' AS type, COUNT("{c}") AS non_null,
        COUNT(*) FILTER ("{c}" IS NULL) AS nulls, COUNT(DISTINCT "{c}") AS distinct_values FROM f"""
        for c in RAW_COLUMNS
    ),
)
def _(t):
    return P.column_profile(t.base)


@query("c11b_column_profile_approx")
def _(t):
    return P.column_profile_approx(t.base)


@query(
    "c12_completeness",
    NUMBERED + " SELECT " + r6(
        "(1-(" + "+".join(f'COUNT(*) FILTER ("{c}" IS NULL)' for c in NULL_COLUMNS) + ")*1e0/(COUNT(*)*22))*100",
        "completeness_percent",
    ) + " FROM nf",
)
def _(t):
    return P.completeness(with_nulls(t))


REPEATED = '"Contract", "PaymentMethod", "InternetService", tenure, "Churn"'


@query(
    "c13_duplicate_rows",
    f"""d AS (SELECT DISTINCT {REPEATED} FROM cl)
    SELECT CAST((SELECT COUNT(*) FROM cl) - COUNT(*) AS BIGINT) AS duplicates FROM d""",
)
def _(t):
    return P.duplicate_rows(
        t.clean.select("Contract", "PaymentMethod", "InternetService", "tenure", "Churn")
    )


@query(
    "c14_constant_columns",
    "u AS (" + union(
        f"""SELECT '{c}' AS "column", COUNT(DISTINCT "{c}") AS d FROM k""" for c in ("Contract", "tenure", "source")
    ).join(("""SELECT * FROM (WITH k AS (SELECT *, 'telecom' AS source FROM cl) """, ")")) + """)
    SELECT "column" FROM u WHERE d=1""",
)
def _(t):
    return P.constant_columns(t.clean.select("Contract", "tenure", F.lit("telecom").alias("source")))


@query(
    "c13b_duplicate_rows_all_columns",
    """d AS (SELECT DISTINCT * FROM cl) SELECT CAST((SELECT COUNT(*) FROM cl) - COUNT(*) AS BIGINT) AS duplicates FROM d""",
)
def _(t):
    return P.duplicate_rows(t.clean)


ALL_COLUMNS = (ROLES.key, *ROLES.features, "Churn")


@query(
    "c14b_constant_columns_all_columns",
    "u AS (" + union(f"""SELECT '{c}' AS "column", COUNT(DISTINCT "{c}") AS d FROM cl""" for c in ALL_COLUMNS) + """)
    SELECT "column" FROM u WHERE d=1""",
)
def _(t):
    return P.constant_columns(t.clean)


@query(
    "c15_high_cardinality",
    union(
        f"""SELECT '{c}' AS "column", COUNT(DISTINCT "{c}") AS distinct_values,
        {r6(f'COUNT(DISTINCT "{c}")*1e0/COUNT(*)', 'distinct_ratio')},
        COUNT(DISTINCT "{c}")*1e0/COUNT(*)>0.5e0 AS over_ratio, COUNT(DISTINCT "{c}")>20 AS over_count FROM f"""
        for c in TEXT_COLUMNS
    ),
)
def _(t):
    return P.high_cardinality(t.base, TEXT_COLUMNS)


@query(
    "c16_categorical_summary",
    long_sql(CATEGORICAL, "cl") + f""", r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k,
      SUM(n) OVER (PARTITION BY "column") AS total, COUNT(*) OVER (PARTITION BY "column") AS d FROM lv)
    SELECT "column", d AS distinct_values, value AS most_frequent, n AS most_frequent_count,
    {r6('n*1e2/total', 'most_frequent_percent')} FROM r WHERE k=1""",
)
def _(t):
    return P.categorical_summary(t.clean, CATEGORICAL)


@query(
    "c17_low_cardinality",
    "u AS (" + union(
        f"""SELECT '{c}' AS "column", COUNT(DISTINCT "{c}") AS distinct_values FROM f""" for c in TEXT_COLUMNS
    ) + ") SELECT * FROM u WHERE distinct_values<=10",
)
def _(t):
    return P.low_cardinality(t.base, TEXT_COLUMNS, 10)


@query(
    "c18_correlation_with_target",
    union(f"""SELECT '{c}' AS "column", {r6(f'CORR("{c}", "Churn")', 'correlation')} FROM cl""" for c in NUMERIC),
)
def _(t):
    return P.correlation_with(t.clean, NUMERIC, "Churn")


@query(
    "c19_correlation_matrix",
    union(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, {r6(f'CORR("{a}", "{b}")', 'correlation')} FROM cl"""
        for a in NUMERIC for b in NUMERIC
    ),
)
def _(t):
    return P.correlation_matrix(t.clean, NUMERIC)


@query(
    "c20_high_correlations",
    "u AS (" + union(
        f"""SELECT '{NUMERIC[i]}' AS column_a, '{NUMERIC[j]}' AS column_b, CORR("{NUMERIC[i]}", "{NUMERIC[j]}") AS r FROM cl"""
        for i in range(3) for j in range(i + 1, 3)
    ) + f""") SELECT column_a, column_b, {r6('r', 'correlation')} FROM u WHERE ABS(r)>0.7e0""",
)
def _(t):
    return P.high_correlations(t.clean, NUMERIC)


@query(
    "c21_feature_statistics",
    union(
        f"""SELECT '{c}' AS "column", {r6(f'AVG("{c}")', 'mean')}, {r6(f'STDDEV_SAMP("{c}")', 'std')},
        CAST(MIN("{c}") AS DOUBLE) AS "min", CAST(MAX("{c}") AS DOUBLE) AS "max" FROM cl"""
        for c in NUMERIC
    ),
)
def _(t):
    return P.feature_statistics(t.clean, NUMERIC)


HISTOGRAM = """s AS (SELECT MIN("MonthlyCharges") AS low, MAX("MonthlyCharges") AS high FROM cl),
    h AS (SELECT CAST(LEAST(FLOOR(("MonthlyCharges"-low)/((high-low)/30)), 29) AS INT) AS bin, low, high FROM cl CROSS JOIN s),
    hist AS (SELECT bin, MIN(low)+bin*(MAX(high)-MIN(low))/30 AS bin_start, COUNT(*) AS n FROM h GROUP BY bin)"""


@query("c22_histogram", HISTOGRAM + f" SELECT bin, {r6('bin_start', 'bin_start')}, n FROM hist")
def _(t):
    return P.histogram(t.clean, "MonthlyCharges")


@query(
    "c22b_histogram_by_label",
    f"""s AS (SELECT "Churn" AS y, MIN("MonthlyCharges") AS low, MAX("MonthlyCharges") AS high FROM cl GROUP BY 1),
    h AS (SELECT y, CAST(LEAST(FLOOR(("MonthlyCharges"-low)/((high-low)/30)), 29) AS INT) AS bin, low, high
      FROM cl JOIN s ON cl."Churn"=s.y)
    SELECT y AS "Churn", bin, {r6('MIN(low)+bin*(MAX(high)-MIN(low))/30', 'bin_start')}, COUNT(*) AS n FROM h GROUP BY y, bin""",
)
def _(t):
    return P.histogram(t.clean, "MonthlyCharges", by="Churn")


@query(
    "c23_box_statistics",
    "b AS (" + union(
        f"""SELECT '{c}' AS "column", "Churn", "customerID", CAST("{c}" AS DOUBLE) AS v FROM cl""" for c in NUMERIC
    ) + f"""), q AS (SELECT "column", "Churn", QUANTILE_CONT(v,0.25) AS a, QUANTILE_CONT(v,0.5) AS m, QUANTILE_CONT(v,0.75) AS z
      FROM b GROUP BY 1,2)
    SELECT b."column", b."Churn", {r6('MAX(a)', 'q25')}, {r6('MAX(m)', 'q50')}, {r6('MAX(z)', 'q75')},
    MIN(v) FILTER (v>=a-(z-a)*1.5e0 AND v<=z+(z-a)*1.5e0) AS whisker_low,
    MAX(v) FILTER (v>=a-(z-a)*1.5e0 AND v<=z+(z-a)*1.5e0) AS whisker_high,
    COUNT(*) FILTER (NOT (v>=a-(z-a)*1.5e0 AND v<=z+(z-a)*1.5e0)) AS outliers
    FROM b JOIN q ON b."column"=q."column" AND b."Churn"=q."Churn" GROUP BY 1,2""",
)
def _(t):
    return P.box_statistics(t.clean, NUMERIC, "Churn")


def _factor(column_sql):
    return f"""o AS (SELECT AVG("Churn") AS overall FROM cl),
    g AS (SELECT {column_sql} AS level, AVG("Churn") AS rate, COUNT(*) AS n FROM cl GROUP BY 1)
    SELECT level, {r6('rate', 'churn_rate')}, n, {r6('rate-overall', 'effect')},
    CASE WHEN rate-overall>0.05e0 THEN 'HIGH' WHEN rate-overall<-0.05e0 THEN 'LOW' ELSE 'none' END AS flag
    FROM g CROSS JOIN o WHERE level IS NOT NULL"""


@query("c24_factor_report", _factor(BAND))
def _(t):
    return P.factor_report(t.clean.withColumn("band", X.tenure_band()), "band", "Churn")


@query(
    "c25_numeric_factor_report",
    f"""r AS (SELECT CORR(tenure, "Churn") AS r, AVG(tenure) AS m, MIN(tenure) AS a, MAX(tenure) AS z FROM cl)
    SELECT 'tenure' AS factor, {r6('r', 'correlation')}, {r6('m', 'mean')}, CAST(a AS DOUBLE) AS "min", CAST(z AS DOUBLE) AS "max",
    CASE WHEN ABS(r)>0.3e0 THEN 'strong' WHEN ABS(r)>0.1e0 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN r>0 THEN 'increases' ELSE 'decreases' END AS direction FROM r""",
)
def _(t):
    return P.numeric_factor_report(t.clean, "tenure", "Churn")


EXTREMES = f"""SELECT (SELECT level FROM g ORDER BY rate DESC, level LIMIT 1) AS highest_level, {r6('MAX(rate)', 'highest_rate')},
    (SELECT level FROM g ORDER BY rate, level LIMIT 1) AS lowest_level, {r6('MIN(rate)', 'lowest_rate')} FROM g"""


@query(
    "c26_worst_tenure_band",
    f"""g AS (SELECT {BAND_REPORT} AS level, AVG("Churn") AS rate FROM cl WHERE {BAND_REPORT} IS NOT NULL GROUP BY 1) {EXTREMES}""",
)
def _(t):
    banded = t.clean.withColumn("band", X.tenure_band_report())
    return P.extreme_levels(P.rate_by_level(banded, "band", "Churn"), "band")


@query(
    "c27_best_and_worst_level",
    f"""g AS (SELECT "Contract" AS level, AVG("Churn") AS rate FROM cl GROUP BY 1) {EXTREMES}""",
)
def _(t):
    return P.extreme_levels(P.rate_by_level(t.clean, "Contract", "Churn"), "Contract")


@query(
    "c30_scoring_summary",
    f"""SELECT COUNT(*) AS total, CAST(SUM(prediction) AS BIGINT) AS predicted_churners,
    {r6('AVG(prediction)*100', 'churn_percent')} FROM sc WHERE model='contract_rule'""",
)
def _(t):
    return P.scoring_summary(t.scored.where(F.col("model") == "contract_rule"))


@query(
    "c31_class_weights",
    f"""SELECT "Churn", COUNT(*) AS n, {r6('SUM(COUNT(*)) OVER ()*1e0/(COUNT(*) OVER ()*COUNT(*))', 'weight')}
    FROM cl GROUP BY 1""",
)
def _(t):
    return P.class_weights(t.clean, "Churn")


@query(
    "c31b_weighted_rows",
    f"""w AS (SELECT "Churn", SUM(COUNT(*)) OVER ()*1e0/(COUNT(*) OVER ()*COUNT(*)) AS weight FROM cl GROUP BY 1)
    SELECT "customerID", cl."Churn", {r6('weight', 'weight')} FROM cl JOIN w ON cl."Churn"=w."Churn" """,
)
def _(t):
    return P.with_class_weights(t.clean, "Churn").select("customerID", "Churn", "weight")


@query(
    "c33_churn_percent_by_category",
    f"""SELECT "Contract", {r6('''AVG(CASE WHEN "Churn"='Yes' THEN 1e0 ELSE 0e0 END)*100''', 'churn_percent')} FROM f GROUP BY 1""",
)
def _(t):
    return P.percent_by_text_label(t.base, "Contract")


@query("c35_scatter_extract", f"""SELECT "customerID", tenure AS x, "MonthlyCharges" AS y, "Churn" FROM cl""")
def _(t):
    return P.scatter_extract(t.clean, "tenure", "MonthlyCharges", "Churn", "customerID")


@query(
    "c36_type_tally",
    """n AS (SELECT COUNT(*) AS k FROM f)
    SELECT type, CAST(c AS BIGINT) AS columns, k AS rows FROM n CROSS JOIN
    (VALUES ('bigint',1),('int',2),('double',1),('string',17)) v(type,c)""",
)
def _(t):
    return P.type_tally(t.base)


def _exploration_sql():
    shape = [
        "SELECT 'shape' AS section, 'rows' AS name, COUNT(*)*1e0 AS value, CAST(NULL AS VARCHAR) AS detail FROM f",
        "SELECT 'shape', 'columns', 21e0, NULL FROM f LIMIT 1",
    ]
    rate = """AVG(CASE WHEN "Churn"='Yes' THEN 1e0 ELSE 0e0 END)*100"""
    shape[1] = f"SELECT * FROM ({shape[1]})"
    shape.append(
        f"SELECT 'shape', 'churn_percent', ROUND({rate}, 6), CASE WHEN {rate}>30 THEN 'high' WHEN {rate}>15 THEN 'moderate' ELSE 'low' END FROM f"
    )
    target = ["""SELECT 'target_distribution', "Churn", COUNT(*)*1e0, NULL FROM f GROUP BY "Churn" """]
    columns = []
    for c in RAW_COLUMNS[:-1]:
        kind = "numerical_feature" if c in TYPES else "categorical_feature"
        columns.append(
            f"""SELECT 'missing_values', '{c}', COUNT(*) FILTER ("{c}" IS NULL)*1e0, '{TYPES.get(c, 'string')}' FROM f"""
        )
        columns.append(
            f"""SELECT '{kind}', '{c}', COUNT(DISTINCT "{c}")*1e0, CASE WHEN COUNT(DISTINCT "{c}")>20 THEN 'high_cardinality' END FROM f"""
        )
    return union(shape + target + columns)


@query("c37_exploration_summary", _exploration_sql())
def _(t):
    return P.exploration_summary(t.base, "Churn")


@query(
    "c38_density_curve",
    HISTOGRAM + f""", w AS (SELECT COUNT(*) AS total, MIN("MonthlyCharges") AS low, MAX("MonthlyCharges") AS high,
      STDDEV_SAMP("MonthlyCharges")*POWER(COUNT(*), -0.2e0) AS h FROM cl),
    grid AS (SELECT CAST(i AS INT) AS point, low+(high-low)*i/49 AS x, h, total, low, high FROM w CROSS JOIN (SELECT UNNEST(RANGE(50)) AS i))
    SELECT point, {r6('x', 'x')}, {r6('SUM(n*EXP(-POWER((x-(bin_start+(high-low)/60))/h,2)/2))/(MAX(total)*MAX(h)*SQRT(2*PI()))', 'density')}
    FROM grid CROSS JOIN hist GROUP BY point, x""",
)
def _(t):
    return P.density_curve(t.clean, "MonthlyCharges")


@query(
    "c39_sample_values",
    long_sql(RAW_COLUMNS) + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value) AS place FROM lv WHERE value IS NOT NULL)
    SELECT "column", CAST(place AS INT) AS place, value FROM r WHERE place<=3""",
)
def _(t):
    return Q.sample_values(t.base, RAW_COLUMNS)


@query(
    "c40_top_levels",
    long_sql(CATEGORICAL[:8], "cl") + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM lv)
    SELECT "column", value, n, CAST(place AS INT) AS place FROM r WHERE place<=10""",
)
def _(t):
    return Q.top_levels(t.clean, CATEGORICAL[:8], 10)


@query(
    "j01_rate_and_count",
    f"""r AS (SELECT "Contract", AVG(CASE WHEN "Churn"='Yes' THEN 1e0 ELSE 0e0 END)*100 AS p FROM f GROUP BY 1),
    c AS (SELECT "Contract" AS k, COUNT(*) AS n FROM f GROUP BY 1)
    SELECT "Contract", {r6('p', 'churn_percent')}, n FROM r JOIN c ON r."Contract"=c.k""",
)
def _(t):
    return P.rate_and_count(t.base, "Contract")


@query("j02_features_with_label", """SELECT "customerID", tenure, "Contract", "Churn" FROM cl""")
def _(t):
    features, label = C.separate(t.clean)
    return features.join(label, ROLES.key).select("customerID", "tenure", "Contract", "Churn")


@query(
    "j03_level_minus_overall",
    f"""o AS (SELECT AVG("Churn") AS overall FROM cl)
    SELECT "InternetService" AS level, {r6('AVG("Churn")-MAX(overall)', 'effect')} FROM cl CROSS JOIN o GROUP BY 1""",
)
def _(t):
    return P.factor_report(t.clean, "InternetService", "Churn").select("level", "effect")


@query(
    "k01_sorted_rates",
    f"""SELECT "PaymentMethod", {r6('AVG("Churn")', 'churn_rate')} FROM cl GROUP BY 1""",
)
def _(t):
    return P.rate_by_level(t.clean, "PaymentMethod", "Churn").orderBy(F.desc("churn_rate"), "PaymentMethod")


CORRELATED = ("u AS (" + union(
    f"""SELECT '{c}' AS "column", CORR("{c}", "Churn") AS r FROM w2""" for c in ("tenure", "MonthlyCharges", "TotalCharges", "ratio", "share")
).join(("""SELECT * FROM (WITH w2 AS (SELECT *, "TotalCharges"/(tenure+1) AS ratio, "MonthlyCharges"/("TotalCharges"+1) AS share FROM cl) """, ")")) + ")")


def _correlated(t):
    derived = t.clean.withColumns(
        {"ratio": X.charge_tenure_ratio(), "share": X.monthly_to_total_ratio()}
    )
    return P.correlation_with(
        derived, ["tenure", "MonthlyCharges", "TotalCharges", "ratio", "share"], "Churn"
    )


@query("k02_top_positive", CORRELATED + f""" SELECT "column", {r6('r', 'correlation')} FROM u ORDER BY r DESC LIMIT 3""")
def _(t):
    return _correlated(t).orderBy(F.desc("correlation"), "column").limit(3)


@query("k03_top_negative", CORRELATED + f""" SELECT "column", {r6('r', 'correlation')} FROM u ORDER BY r LIMIT 3""")
def _(t):
    return _correlated(t).orderBy("correlation", "column").limit(3)


@query(
    "b01_count_yes_per_row",
    """SELECT "customerID", CASE WHEN "OnlineSecurity"='Yes' THEN 1 ELSE 0 END + CASE WHEN "StreamingTV"='Yes' THEN 1 ELSE 0 END AS yes_count FROM cl""",
)
def _(t):
    return t.clean.select("customerID", count_yes(["OnlineSecurity", "StreamingTV"]).alias("yes_count"))


@query(
    "b02_percent_by_group",
    f"""SELECT "InternetService", {r6('''AVG(CASE WHEN "Churn"='Yes' THEN 1e0 ELSE 0e0 END)*100''', 'churn_percent')} FROM f GROUP BY 1""",
)
def _(t):
    return P.percent_by_text_label(t.base, "InternetService")


@query(
    "b03_direction_per_row",
    f"""m AS (SELECT AVG(probability) AS avg_p FROM sc)
    SELECT "customerID", model, {TIER} AS tier, CASE WHEN probability-avg_p>0 THEN 'increases' ELSE 'decreases' END AS direction
    FROM sc CROSS JOIN m""",
)
def _(t):
    mean = t.scored.agg(F.avg("probability").alias("avg_p"))
    return (
        t.scored.crossJoin(F.broadcast(mean))
        .select(
            "customerID", "model", risk_tier("probability").alias("tier"),
            direction(F.col("probability") - F.col("avg_p")).alias("direction"),
        )
    )

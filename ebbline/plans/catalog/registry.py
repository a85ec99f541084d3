"""Named queries: a builder over the tables of a folder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.plans import fixtures

# Customer table (f), cleaned customer table (cl), rule scores (sc) and planted table (pl).
COMMON = """
WITH pre AS (
  SELECT o_custkey, COUNT(*) AS n_orders, CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents,
         SUM(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS p1,
         SUM(CASE WHEN o_orderpriority='2-HIGH' THEN 1 ELSE 0 END) AS p2,
         SUM(CASE WHEN o_orderpriority='3-MEDIUM' THEN 1 ELSE 0 END) AS p3,
         SUM(CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS p4,
         SUM(CASE WHEN o_orderpriority='5-LOW' THEN 1 ELSE 0 END) AS p5,
         SUM(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS sp
  FROM orders WHERE o_orderdate < TIMESTAMP '2001-02-01 00:00:00' GROUP BY o_custkey),
post AS (SELECT DISTINCT o_custkey FROM orders
         WHERE o_orderdate >= TIMESTAMP '2001-02-01 00:00:00'),
f AS (SELECT c.c_custkey AS "customerID",
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS "SeniorCitizen",
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Partner",
  CASE WHEN c.c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
  CAST(CASE WHEN c.c_custkey % 50 = 0 THEN 0 ELSE LEAST(p.n_orders*4, 72) END AS INT) AS tenure,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'No' ELSE 'Yes' END AS "PhoneService",
  CASE WHEN c.c_custkey % 10 = 0 THEN 'No phone service'
       WHEN c.c_custkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS "MultipleLines",
  CASE WHEN n.n_regionkey=0 THEN 'No' WHEN n.n_regionkey<3 THEN 'DSL' ELSE 'Fiber optic' END AS "InternetService",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN p1>=2 THEN 'Yes' ELSE 'No' END AS "OnlineSecurity",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN p2>=2 THEN 'Yes' ELSE 'No' END AS "OnlineBackup",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN p3>=2 THEN 'Yes' ELSE 'No' END AS "DeviceProtection",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN p4>=2 THEN 'Yes' ELSE 'No' END AS "TechSupport",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN p5>=2 THEN 'Yes' ELSE 'No' END AS "StreamingTV",
  CASE WHEN n.n_regionkey=0 THEN 'No internet service' WHEN sp>=4 THEN 'Yes' ELSE 'No' END AS "StreamingMovies",
  CASE WHEN n_orders<8 THEN 'Month-to-month' WHEN n_orders<11 THEN 'One year' ELSE 'Two year' END AS "Contract",
  CASE WHEN c.c_custkey % 7 < 4 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
  c.c_mktsegment AS "PaymentMethod",
  CAST((2*cents + 3000*n_orders)//(6000*n_orders) AS DOUBLE)/100 AS "MonthlyCharges",
  CASE WHEN c.c_custkey % 50 = 0 THEN ' '
       ELSE CAST((2*cents+3000)//6000//100 AS VARCHAR) || '.'
         || LPAD(CAST((2*cents+3000)//6000 % 100 AS VARCHAR), 2, '0') END AS "TotalCharges",
  CASE WHEN q.o_custkey IS NULL THEN 'Yes' ELSE 'No' END AS "Churn"
FROM customer c JOIN pre p ON c.c_custkey=p.o_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey
LEFT JOIN post q ON c.c_custkey=q.o_custkey),
cl AS (SELECT * REPLACE (
  COALESCE(TRY_CAST(TRIM("TotalCharges") AS DOUBLE), 0e0) AS "TotalCharges",
  CAST("SeniorCitizen" AS VARCHAR) AS "SeniorCitizen",
  CAST(CASE "Churn" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS INT) AS "Churn") FROM f),
wide AS (SELECT "customerID", "Churn" AS label,
  ROUND(LEAST(0.3e0 + CASE "Contract" WHEN 'Month-to-month' THEN 0.3e0 WHEN 'One year' THEN 0.1e0 ELSE 0e0 END
    + CASE WHEN tenure<12 THEN 0.2e0 ELSE 0e0 END
    + CASE WHEN "MonthlyCharges">70 THEN 0.1e0 ELSE 0e0 END, 0.9e0), 6) AS contract_rule,
  ROUND(1 - tenure/73e0, 6) AS tenure_rule,
  ROUND(LEAST("MonthlyCharges"/100, 1e0), 6) AS charges_rule FROM cl),
sc AS (SELECT "customerID", label, model, probability,
  CASE WHEN probability > 0.5e0 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT "customerID", label, 'contract_rule' AS model, contract_rule AS probability FROM wide
  UNION ALL SELECT "customerID", label, 'tenure_rule', tenure_rule FROM wide
  UNION ALL SELECT "customerID", label, 'charges_rule', charges_rule FROM wide)),
pl AS (
  SELECT id, c, t, CASE WHEN u3 < 0.2e0 + 0.15e0*t + 0.3e0*c THEN 1 ELSE 0 END AS y FROM (
    SELECT id, u3, c, CASE WHEN u2 < 0.2e0 + 0.5e0*c THEN 1 ELSE 0 END AS t FROM (
      SELECT o_orderkey AS id, ((o_orderkey*104729) % 10009)/10009e0 AS u2,
             ((o_orderkey*1299709) % 10037)/10037e0 AS u3,
             CASE WHEN ((o_orderkey*7919) % 10007)/10007e0 < 0.5e0 THEN 1 ELSE 0 END AS c
      FROM orders)))
""".strip()


class Tables:
    """The derived tables of one folder; all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def base(self) -> DataFrame:
        return fixtures.churn_base(self.spark, self.folder)

    @cached_property
    def clean(self) -> DataFrame:
        return fixtures.churn_clean(self.spark, self.folder)

    @cached_property
    def scored(self) -> DataFrame:
        return fixtures.rule_scored(self.spark, self.folder)

    @cached_property
    def planted(self) -> DataFrame:
        return fixtures.planted(self.spark, self.folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to 6 digits, so that results compare across engines and summation orders."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[(F.round(c, digits) + 0.0).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def query(name: str, sql: str | None = None):
    """Register a builder under ``name``. ``sql`` continues the common tables above."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(Tables(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            starts = text.upper().startswith("SELECT")
            ORACLES[name] = COMMON + ("\n" if starts else ",\n") + text
        return build

    return register


def r6(expression: str, name: str) -> str:
    """SQL text: the expression as a double rounded to 6 digits."""
    return f"ROUND(CAST({expression} AS DOUBLE), 6) + 0e0 AS {name}"

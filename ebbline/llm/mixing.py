"""Mix of sources by Efraimidis-Spirakis sampling.

Every document draws the key `-ln(u) / weight`; u comes from a hash of its id, so reruns agree. A
source whose target is r times its size gives floor(r) complete epochs; the rest of its target is
filled with documents in the order of their keys, up to the token budget.

The running sum over a source has no single task: keys are cut into ranges of about `ROWS_PER_RANGE`
rows, range totals give each range its start, and only rows of one range are sorted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.shared import stored

#: Fixed values of the registered query: weights by rank of the source, most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Weights in the draw by labelled quality: good, unlabelled, bad.
GOOD, UNKNOWN, BAD = 2.0, 1.0, 0.5
ROWS_PER_RANGE = 10_000
SEED = "mix-1"

ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 1)::DOUBLE
             / 4503599627370497.0)
         / CASE WHEN l.quality >= 1 THEN 2.0::DOUBLE WHEN l.quality < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS most,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE AS open_size,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS open_weight
  FROM s
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(open_size / open_weight) FILTER (open_size * weight <= most * open_weight) AS level FROM o),
t AS (
  SELECT source, source_size, least(most::DOUBLE, weight * level) AS target FROM o, level),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.target - epochs * t.source_size AS budget, epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
               FROM t) t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN 2 * upto - size < 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """Targets of all sources: `source`, `source_size`, `target`; one row per source.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes by
    them. No target is above most_epochs times its source's size: ordered by that limit per weight,
    the sources before the water level are full and the others share the rest by weight. From the first
    source that fits on, the level of an open rest only falls, so it is the largest of those that fit.
    The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    table = sizes.select("source", F.col("source_size"), F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    table = table.withColumn("most", most_epochs * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = table.withColumns(
        {
            "open_size": (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double"),
            "open_weight": (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"),
        }
    )
    fits = F.col("open_size") * F.col("weight") <= F.col("most") * F.col("open_weight")
    table = table.withColumn("level", F.max(F.when(fits, F.col("open_size") / F.col("open_weight"))).over(everything))
    return table.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def text_weight(text: Column) -> Column:
    """Quality weight of a text itself: 0.5 and the share of its characters that are letters."""
    letters = F.char_length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    return 0.5 + F.coalesce(letters / F.nullif(F.char_length(text), F.lit(0)), F.lit(0.0))


def exponential_key(own_id: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from a hash of the id; a null id counts as an empty string."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(own_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1).cast("double") / F.lit(4503599627370497.0)
    return -F.log(u) / weight


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Draw the mix from (`id`, `hash`, `source`, `size`, `key`): adds `source_size`, `target`, `epochs`, `copies`, `taken`.

    The last document of the fractional part is taken when that brings the sum nearer to the target.
    Ties of keys go by id (null last), then size, then hash. Documents without words take part with
    size 0. An empty table gives an empty result.
    """
    sizes = stored(sizes, "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = stored(source_targets(totals, weights, most_epochs).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    # 1 - exp(-key) grows with the key and is even for weight 1: ranges are about the same size.
    ranges = F.ceil(F.col("rows") / ROWS_PER_RANGE)
    sizes = sizes.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    sizes = sizes.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long"))
    ranged = ["source", "range"]
    starts = sizes.groupBy(ranged).agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    order = Window.partitionBy(ranged).orderBy("key", F.col("id").asc_nulls_last(), "size", "hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = sizes.withColumn("within", F.sum("size").over(order))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"epochs": epochs, "upto": F.col("start") + F.col("within")})
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("copies", F.col("epochs") + F.when(2 * F.col("upto") - F.col("size") < 2 * budget, 1).otherwise(0))
    return rows.select("id", "hash", "source", "size", "key", "source_size", "target", "epochs", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def document_sizes(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Input of mix(): sizes in words and keys weighted by the labelled quality of each document.

    Labels of one id are combined to the best; without a label the weight is `UNKNOWN`.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    if labels is not None:
        best = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality")).where("labelled IS NOT NULL")
        rows = rows.join(best, F.col("id") == F.col("labelled"), "left").drop("labelled")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    weight = F.when(F.col("quality") >= 1, GOOD).when(F.col("quality") < 1, BAD).otherwise(UNKNOWN)
    return rows.withColumn("key", exponential_key(F.col("id"), weight)).drop("quality")


def mixed_documents(docs: DataFrame, weight: Callable[[Column], Column] = text_weight, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn rows of docs with all their columns, and how often each is repeated in `copies`.

    weight gives the quality weight from the text. The mix is drawn over narrow rows; what comes back
    to the texts is one row per source, its epochs and its last drawn place, so texts are read in place
    and never shuffled. Repeated rows are drawn alike. A column of docs called `copies` is replaced.
    """
    docs = docs.drop("copies")
    own_columns = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]
    own_id, text, source = docs[id_col], docs[text_col], docs[source_col].cast("string")
    size, text_hash, key = word_count(text), F.xxhash64(text), exponential_key(own_id, weight(text))
    sizes = docs.select(own_id.alias("id"), text_hash.alias("hash"), source.alias("source"), size.alias("size"), key.alias("key"))

    def place(key: Column, own_id: Column, size: Column, text_hash: Column) -> Column:
        parts = {"key": key, "no_id": own_id.isNull(), "id": own_id, "size": size, "hash": text_hash}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    last = F.max(F.when(F.col("copies") > F.col("epochs"), place(*map(F.col, ("key", "id", "size", "hash")))))
    cuts = mix(sizes).groupBy("source").agg(F.max("epochs").alias("epochs"), last.alias("last"))
    cuts = stored(cuts, "cuts")
    drawn = cuts["last"].isNotNull() & (place(key, own_id, size, text_hash) <= cuts["last"])
    copies = cuts["epochs"] + F.when(drawn, 1).otherwise(0)
    mixed = docs.join(cuts, source.eqNullSafe(cuts["source"])).select(*own_columns, copies.alias("copies"))
    return mixed.where("copies > 0")

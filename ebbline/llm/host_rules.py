"""Quality rules judged by host.

Every document is measured in one narrow pass. Failures of its rules are counted by host, ahead of the
shuffle, so a host that holds a third of all rows is one row a task. The rate of each host is drawn towards the mean of
all hosts by a beta prior fitted to the hosts themselves: a host with few documents is judged by little more than
the prior, one with many by its own rate. The verdict of a host is joined back to its documents:

- `trusted`: a document goes only if it fails a base rule;
- `watched`: it also goes if it fails any other rule;
- `rejected`: all its documents go.

Hosts other than trusted ones are all that is joined, one row a host.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import quoted, stored

#: Fixed values of the base rules: fewest words, most words in repeated windows (percent), words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Shrunk failure rates from which a host is watched and rejected.
WATCHED_FROM, REJECTED_FROM = 0.3, 0.6

WHITE = "[\\x20\\x09-\\x0D]+"

ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT row_id, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
positions AS (
  SELECT row_id, unnest(range(1, len(words) - 3)) AS place, words FROM w WHERE len(words) >= 5),
windows AS (
  SELECT row_id, place, count(*) OVER (PARTITION BY row_id, array_to_string(words[place:place + 4], ' ')) AS n FROM positions),
covered AS (
  SELECT row_id, least(5, place - coalesce(lag(place) OVER (PARTITION BY row_id ORDER BY place), -9)) AS fresh FROM windows WHERE n > 1),
repeated AS (SELECT row_id, sum(fresh)::BIGINT AS n_repeat_words FROM covered GROUP BY row_id),
m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (row_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS other_failed
  FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS n, (count(*) FILTER (base_failed OR other_failed))::DOUBLE AS k FROM f GROUP BY source),
s AS (
  SELECT sum(n) AS docs, sum(k) / sum(n) AS mean, sum(k * k / n) - sum(k) * sum(k) / sum(n) AS spread,
         count(*)::DOUBLE AS hosts, sum(n * n) / sum(n) AS evenness FROM h),
g AS (
  SELECT *, CASE WHEN mean * (1 - mean) * (docs - evenness - (hosts - 1)) > 0
                 THEN (spread - mean * (1 - mean) * (hosts - 1)) / (mean * (1 - mean) * (docs - evenness - (hosts - 1)))
                 ELSE 0 END AS within FROM s),
p AS (SELECT mean, 1 / least(greatest(within, 1e-6), 0.999999) - 1 AS strength FROM g),
v AS (
  SELECT source, CASE WHEN rate >= 0.6 THEN 'rejected' WHEN rate >= 0.3 THEN 'watched' ELSE 'trusted' END AS host_verdict
  FROM (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM h, p))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_verdict <> 'rejected' AND (host_verdict = 'trusted' OR NOT other_failed) AS kept, host_verdict
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an argument of a lambda is not expanded into it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(prints: Column) -> Column:
    """Words in windows found twice or more, from the fingerprints of all windows in order."""

    def positions(ordered: Column) -> Column:
        def again(pair: Column, j: Column) -> Column:
            near = F.coalesce(F.get(ordered, j - 1)["print"] == pair["print"], F.lit(False))
            return near | F.coalesce(F.get(ordered, j + 1)["print"] == pair["print"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, again), lambda pair: pair["at"]))

    pairs = F.sort_array(F.transform(prints, lambda x, i: F.struct(x.alias("print"), i.alias("at"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))

    def add(held: Column, at: Column) -> Column:
        return F.struct((held["total"] + F.least(F.lit(WINDOW), at - held["last"])).alias("total"), at.alias("last"))

    return F.aggregate(_let(pairs, positions), start, add, lambda held: held["total"])


def repeated_words(words: Column) -> Column:
    """Number of words in windows of `WINDOW` words that occur twice or more in the array, first ones included."""
    zero = F.lit(0).cast("long")

    def windows(prints: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(prints) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*(F.get(prints, i + k) for k in range(WINDOW))))

    def count(prints: Column) -> Column:
        return F.when(F.size(F.array_distinct(prints)) == F.size(prints), zero).otherwise(_covered(prints))

    def whole(own: Column) -> Column:
        prints = F.transform(own, lambda w: F.xxhash64(w))
        return F.when(F.size(own) < WINDOW, zero).otherwise(_let(_let(prints, windows), count))

    return _let(words, whole)


def measures(text: Column) -> Column:
    """Struct of all counts of a text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are `[^\\x20\\x09-\\x0D]+`; lines are those between line feeds that hold a word. A null text counts as empty.
    """
    content = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(content, WHITE), lambda w: w != "")
    lines = F.filter(F.split(content, "\\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))

    def of_words(own: Column) -> Column:
        return F.struct(
            F.size(own).cast("long").alias("n_words"),
            F.char_length(F.array_join(own, "")).cast("long").alias("word_chars"),
            repeated_words(own).alias("n_repeat_words"),
        )

    def of_lines(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n_lines"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"))

    symbols = F.regexp_count(content, F.lit("[#*$%&|<>]")).cast("long")
    return F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


#: The base rules; a document that fails one is dropped on any host.
BASE_RULES: dict[str, str] = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
}
#: The other rules: they count towards the rate of the host, and drop a document where the host is watched.
HOST_RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
}


def host_rates(failures: DataFrame) -> DataFrame:
    """Rates by host from (`host`, `n` documents, `k` failed): adds `rate`, `shrunk_rate`.

    The prior is a beta distribution whose mean is the rate of all documents and whose strength follows
    from the spread of the hosts' rates beyond chance, by moments weighted with n. With one host, equal rates or
    no failures that spread is 0 or less: the prior is then as strong as 999,999 documents. Sums of whole
    numbers are exact; only one row of sums is sent to all tasks.
    """
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = failures.agg(
        F.sum(n).alias("docs"), F.sum(k).alias("failed"), F.sum(k * k / n).alias("squares"), F.count("*").cast("double").alias("hosts"), F.sum(n * n).alias("sizes"),
    )
    mean = F.col("failed") / F.col("docs")
    chance = mean * (1 - mean)
    room = chance * (F.col("docs") - F.col("sizes") / F.col("docs") - (F.col("hosts") - 1))
    spread = F.col("squares") - F.col("failed") * F.col("failed") / F.col("docs")
    within = F.when(room > 0, (spread - chance * (F.col("hosts") - 1)) / room).otherwise(0.0)
    strength = 1 / F.least(F.greatest(within, F.lit(1e-6)), F.lit(0.999999)) - 1
    prior = sums.where("docs > 0").select(mean.alias("mean"), strength.alias("strength"))
    rated = failures.crossJoin(F.broadcast(prior))
    shrunk = (k + F.col("mean") * F.col("strength")) / (n + F.col("strength"))
    return rated.select("host", "n", "k", (k / n).alias("rate"), shrunk.alias("shrunk_rate"))


def judge_by_host(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    watched_from: float = WATCHED_FROM, rejected_from: float = REJECTED_FROM,
) -> DataFrame:
    """One row per row of docs: `id`, `host`, all counts, `failed` (names of rules), `base_failed`, `host_rate`, `host_verdict`, `kept`.

    host_rate is null for trusted hosts, which are not joined. A null host is a host of its own. A null or empty text has no words and fails
    `few_words`; texts may be of any length. Repeated rows are counted and judged as any other. An empty table gives an empty
    result. Other columns of docs are not read, whatever their names.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(host_col).cast("string").alias("host"), measures(quoted(text_col)).alias("m"))
    counts = ("w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    rows = rows.select("id", "host", *(F.col(f"m.{c}") for c in counts))

    def failing(rules: dict[str, str]) -> Column:
        return F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items())))

    rows = rows.select("*", failing(BASE_RULES).alias("base"), failing(HOST_RULES).alias("other"))
    rows = stored(rows, "measured")
    failed = F.size("base") + F.size("other") > 0
    failures = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(failed).alias("k"))
    rates = host_rates(stored(failures, "hosts"))
    verdict = F.when(F.col("shrunk_rate") >= rejected_from, "rejected").otherwise("watched")
    judged = rates.where(F.col("shrunk_rate") >= watched_from).select(F.col("host").alias("own"), F.col("shrunk_rate").alias("host_rate"), verdict.alias("verdict"))
    judged = stored(judged, "verdicts")
    found = rows.join(judged, rows["host"].eqNullSafe(judged["own"]), "left")
    base_failed = F.size("base") > 0
    verdict = F.coalesce(F.col("verdict"), F.lit("trusted"))
    kept = ~base_failed & (verdict != "rejected") & ((verdict == "trusted") | (F.size("other") == 0))
    return found.select(
        "id", "host", *(c.split(".")[-1] for c in counts), F.concat("base", "other").alias("failed"), base_failed.alias("base_failed"),
        "host_rate", verdict.alias("host_verdict"), kept.alias("kept"),
    )

"""URL rules found by their rarest literal token.

A rule is a regular expression with the literal tokens every matching URL must hold. Each rule is
posted under the one of its tokens that occurs in the fewest URLs of the table; a URL's tokens fetch
the rules posted under them, and only those regular expressions run. Rules without a token run on
every URL.

The rule list is a parameter and lives on the driver, so its size bounds the broadcast index; the
token counts sent to the driver have one row per token of the rules.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the registered query.
CONTRACT_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
                     ('allow', 'com/fr/'), ('block', 'com/de/')),
m AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
  FROM p JOIN r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
               AND starts_with(p.path, substr(r.rule, instr(r.rule, '/')))
  GROUP BY ALL)
SELECT page_id, host, path, rule, verdict FROM m
UNION ALL
SELECT page_id, coalesce(host, ''), coalesce(path, ''), NULL, 'allow' FROM p
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = p.page_id AND m.host = p.host AND m.path = p.path)
"""

_TOKEN = re.compile(r"[^/.:?#&=]+")
#: Ends of tokens inside a URL, for Spark's split.
_ENDS = r"[/.:?#&=]"


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block; pattern: matched from the start of `host + path`; tokens: literals it needs."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_path_rule(verdict: str, rule: str) -> Rule:
    """`host/path`: fits the host and its subdomains when the path starts with the rule's path.

    The last piece of the path may go on inside a URL, so it is no token of its own.
    """
    host, _, path = rule.partition("/")
    whole = _TOKEN.findall(host) + _TOKEN.findall(path.rpartition("/")[0] if "/" in path else "")
    pattern = rf"(?s)(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    return Rule(rule, verdict, pattern, tuple(dict.fromkeys(whole)))


class RuleIndex:
    """Rules posted under their rarest token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.posted: dict[str, list[tuple[re.Pattern, Rule]]] = defaultdict(list)
        self.always: list[tuple[re.Pattern, Rule]] = []
        for rule in rules:
            entry = (re.compile(rule.pattern), rule)
            if rule.tokens:
                self.posted[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; of equally long ones the block, then the first by name."""
        url, best, posted = host + path, None, self.posted
        fetched = [entry for token in set(_TOKEN.findall(url)) if token in posted for entry in posted[token]]
        for pattern, rule in fetched + self.always:
            if pattern.match(url) and (best is None or _rank(rule) < _rank(best)):
                best = rule
        return best


def _rank(rule: Rule) -> tuple[int, bool, str]:
    return -len(rule.name), rule.verdict != "block", rule.name


def _parts(urls: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path to (`id`, `url`); both empty for null and for no `://`."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    urls = urls.withColumn("rest", rest).withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, char_length(host) + 1)"), "^[^?#]*", 0)
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("path", path).withColumn("host", lower).select("id", "host", "path")


def token_counts(parts: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules occurs; tokens that occur in none are left out."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return {}
    tokens = F.split(F.concat("host", "path"), _ENDS)
    found = parts.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: `id`, `host`, `path`, `rule` (null if none fits), `verdict`.

    A URL that no rule fits gets `default`. Only the id and the URL are read.
    """
    parts = _parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    index = parts.sparkSession.sparkContext.broadcast((tuple(rules), token_counts(parts, rules)))
    schema = f"id {dict(parts.dtypes)['id']}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = RuleIndex(*index.value)
        for batch in batches:
            found = [own.find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            names = pa.array([r and r.name for r in found], pa.string())
            verdicts = pa.array([r.verdict if r else default for r in found], pa.string())
            columns = [batch["id"], batch["host"], batch["path"], names, verdicts]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, schema)

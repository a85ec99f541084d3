"""Periodic runs of words by scale-tiled distribution.

A run is a stretch of words that repeats with a smallest period q over `max(24, 3 * q)` words or more
and that no neighbouring word extends. Put as matches: position i matches for period p if words i and
i + p are equal, and a run of period p is a maximal stretch of matches plus p words.

Every document is exploded into overlapping tiles, one set a period octave: an octave of periods
`[B, 2 B)` has a boundary at every multiple of B, and the tile of a boundary reaches from B words before
it to 4 B words after it. A stretch of at least 2 B matches holds a whole block of B words behind some boundary, so a
tile is solved only if the fingerprint of that block occurs again one period later. A tile knows
nothing of others: a Z-function from the boundary on gives the matches to the right for all its periods, a
comparison back from the boundary those to the left. It gives fragments `[start, stop)` of stretches;
tiles overlap, so the fragments of a stretch do too. Fragments are shuffled by document and period and
stitched where they touch. A tile leaves out periods that a divisor explains there (Fine and Wilf), so
text that repeats one word gives fragments of period 1 only.

Work on a text of n words is of order n log n. Texts are not shuffled: those with fragments (only) are written
beside their fragments and read again once their runs are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.llm.shared import quoted, stored, text_batches
from ebbline.llm.text_arrays import mix

#: Fewest words of a run, and its fewest periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Block of the first octave, which takes all periods up to twice its size.
FIRST_BLOCK = 8
#: Rows and bytes after which a task hands on what it has.
ROWS_OUT, BYTES_OUT = 500, 1 << 22

_SCANNED = "hash long, n_words long, fragments array<struct<period:long,start:long,stop:long>>, words binary, collapsed string"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def split_words(own_id: object, text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8."""
    return text.split()


def joined(words: Sequence[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def z_function(s: Sequence[int], upto: int) -> list[int]:
    """For each i < upto the number of equal items at the starts of s and of s[i:]; s[0] is taken as 0."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
            elif k < right - i:
                z[i] = k
                continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(items: list[int], ids: np.ndarray, boundary: int, block: int) -> Iterator[tuple[int, int, int]]:
    """Fragments (period, start, stop) of the tile at a boundary, for primitive periods of its octave."""
    z = np.array(z_function(items[boundary : boundary + 4 * block], 2 * block), np.int64)
    reach = z + np.arange(len(z))
    reach[:1] = 0
    # The furthest that a smaller period of at most block words holds, for each period.
    explained = np.concatenate(([0], np.maximum.accumulate(reach)))[np.minimum(np.arange(len(z)), block + 1)]
    lowest = 1 if block == FIRST_BLOCK else block
    periods = np.flatnonzero(z >= block)
    for p in periods[periods >= lowest].tolist():
        if explained[p] >= p + block:
            continue
        first = max(0, boundary - block)
        differs = np.flatnonzero(ids[first:boundary] != ids[first + p : boundary + p])
        start = first + int(differs[-1]) + 1 if len(differs) else first
        yield p, start, boundary + min(int(z[p]), 2 * block)


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Octave after octave: its block size and the boundaries whose block occurs again one period later."""
    n = len(ids)
    prints, width, block = mix(ids.astype(np.uint64) + np.uint64(1)), 1, FIRST_BLOCK
    while n >= LEAST_WORDS and LEAST_PERIODS * (1 if block == FIRST_BLOCK else block) <= n:
        while width < block:
            prints = mix(prints[:-width] * np.uint64(0x9E3779B97F4A7C15) + prints[width:])
            width *= 2
        rows = -(-len(prints) // block)
        grid = np.zeros((rows + 1) * block, np.uint64)
        grid[: len(prints)] = prints
        grid = grid.reshape(-1, block)
        own = grid[:-1, :1]
        hot = (grid[1:] == own).any(axis=1)
        if block == FIRST_BLOCK:
            hot |= (grid[:-1, 1:] == own).any(axis=1)
        yield block, (np.flatnonzero(hot) * block).tolist()
        block *= 2


def fragments(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, stop) of all tiles of a text; those that touch within a period are joined."""
    if len(words) < LEAST_WORDS:
        return []
    numbers: dict[bytes, int] = {}
    items = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(items):
        return []
    ids = np.array(items, np.int64)
    found: dict[int, list[list[int]]] = {}
    for block, at in boundaries(ids):
        for boundary in at:
            for period, start, stop in solve_tile(items, ids, boundary, block):
                own = found.setdefault(period, [])
                if own and start <= own[-1][1]:
                    own[-1][1] = max(stop, own[-1][1])
                else:
                    own.append([start, stop])
    return [(p, start, stop) for p, own in found.items() for start, stop in own]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows (each with its size in bytes first) as batches of bounded rows and bytes."""
    held, size = [], 0
    for bytes_, *row in rows:
        held.append(row)
        size += bytes_
        if len(held) >= ROWS_OUT or size >= BYTES_OUT:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _struct(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, pa.int64()) for n in names]))


def _scan(words_of: Callable, render: Callable) -> Callable:
    def rows(batches):
        for batch in batches:
            own_ids, hashes = batch.column("id"), batch.column("hash").to_pylist()
            for i in range(batch.num_rows):
                own_id = own_ids[i].as_py()
                words = words_of(own_id, batch.column("content")[i].as_py())
                found = fragments(words)
                packed = [{"period": p, "start": s, "stop": e} for p, s, e in found]
                kept, shown = (b" ".join(words), None) if found else (None, render(words))
                yield (len(kept or shown or "") + 24 * len(found) + 64, own_id, hashes[i], len(words), packed, kept, shown)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("id", first.schema.field("id").type), ("hash", pa.int64()), ("n_words", pa.int64()), ("fragments", _struct("period", "start", "stop")), ("words", pa.binary()), ("collapsed", pa.string())])
        yield from _batches(rows(_again(first, batches)), schema)

    return scan


def _again(first, rest):
    yield first
    yield from rest


def distinct_runs(runs: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period; of one interval only the smallest period."""
    least: dict[tuple[int, int], int] = {}
    for start, length, period in runs:
        least[start, length] = min(period, least.get((start, length), period))
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def kept_words(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """Words outside all runs, or among the first period of every run that holds them."""
    kept, done = [], 0
    # Runs by start: a later run may begin before an earlier one ends.
    for first, last in sorted((start + period, start + length) for start, length, period in runs):
        if last > done:
            kept.extend(words[done : max(first, done)])
            done = last
    kept.extend(words[done:])
    return kept


def _collapse(render: Callable) -> Callable:
    def rows(batches):
        for batch in batches:
            own_ids = batch.column("id")
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py().split(b" ")
                found = batch.column("runs")[i].as_py() or []
                found = distinct_runs([(r["start"], r["length"], r["period"]) for r in found])
                shown = render(kept_words(words, found))
                packed = [{"start": s, "length": n, "period": p} for s, n, p in found]
                yield (len(shown) + 24 * len(found) + 64, own_ids[i].as_py(), len(words), packed, shown)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("id", first.schema.field("id").type), ("n_words", pa.int64()), ("runs", _struct("start", "length", "period")), ("collapsed", pa.string())])
        yield from _batches(rows(_again(first, batches)), schema)

    return collapse


def stitch(found: DataFrame) -> DataFrame:
    """Maximal runs (`id`, `hash`, `start`, `length`, `period`) from fragments (`id`, `hash`, `period`, `start`, `stop`).

    Fragments of one document and period are joined where they touch; repeated fragments count once.
    """
    key = ["id", "hash", "period"]
    once = found.groupBy(*key, "start").agg(F.max("stop").alias("stop"))
    by_start = Window.partitionBy(*key).orderBy("start")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = once.withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = marked.withColumn("stretch", F.sum("opens").over(by_start))
    runs = numbered.groupBy(*key, "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.select("id", "hash", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    words_of: Callable[[object, bytes], list[bytes]] = split_words, render: Callable[[Sequence[bytes]], str] = joined,
) -> DataFrame:
    """One row per row of docs: `id`, `n_words`, `runs` (start, length, period), `collapsed`.

    runs is sorted by start, then period. collapsed is `render` of the words that stay when every run keeps
    its first period only (by default joined with spaces). words_of(id, text) gives the words of a text.
    A null or empty text has no words, no runs and an empty collapsed text; a text may be of any length.
    Repeated rows and a null id give a row each. An empty table gives an empty result. Other columns
    of docs are not read, whatever their names.
    """
    content = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(quoted(id_col).alias("id"), F.xxhash64(content).alias("hash"), content.alias("content"))
    id_type = rows.schema["id"].dataType.simpleString()
    scanned = text_batches(rows).mapInArrow(_scan(words_of, render), f"id {id_type}, {_SCANNED}")
    scanned = stored(scanned, "tiles")
    own = ["id", "hash"]
    fragmented = scanned.where("size(fragments) > 0")
    runs = stitch(fragmented.select(*own, F.explode("fragments").alias("f")).select(*own, "f.period", "f.start", "f.stop"))
    runs = runs.groupBy(*own).agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    runs = stored(runs.select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), "runs"), "runs")
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash"))
    collapsed = fragmented.join(runs, same, "left").select("id", "words", "runs")
    collapsed = collapsed.mapInArrow(_collapse(render), f"id {id_type}, n_words long, runs {_RUNS}, collapsed string")
    plain = scanned.where("size(fragments) = 0").select("id", "n_words", F.array().cast(_RUNS).alias("runs"), "collapsed")
    return plain.unionByName(collapsed)

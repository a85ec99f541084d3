"""Near duplicates by an inverted join over MinHash signature coordinates.

1. Every text becomes its set of 5-word shingles and a signature of `COORDINATES` minima. Equal sets
   are one class, so copies never meet as pairs.
2. A class is posted under coordinate-value pairs. Links agree in `matches` coordinates or more, so
   they share one of any `COORDINATES - matches + 1` of them: only the rarest pairs of a class are
   posted. Rarity comes from a count of all postings in `BUCKETS` hash buckets.
3. In each posting list collisions are counted on whole signatures. Classes already reached from an
   earlier one of the list are skipped, so a list gives fewer pairs than it has members. Lists with the
   same members are counted once; long lists are cut into pairs of blocks.
4. The pairs chain classes into families. Inside a family every link is confirmed on the full shingle
   sets, in pairs of blocks of bounded size.
5. Confirmed links give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.components import components
from ebbline.llm.shared import drop_judged, stored, text_batches
from ebbline.llm.text_arrays import SPACED, hashed_words, mix

#: Words of a shingle, percent of the union that two linked sets share.
SHINGLE = 5
PERCENT = 85
COORDINATES = 128
#: Standard deviations by which a link's matches may stay below their mean before it is missed.
SLACK = 5.0
BUCKETS = 1 << 18
LIST_BLOCK = 4096
FAMILY_BLOCK = 256
#: Shingles of a block of a family: 8 bytes each, so 8 MB.
BLOCK_SHINGLES = 1 << 20
#: Shingles whose documents are compared in one matrix product.
SLAB = 4096

ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.root < links.b),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_WORD_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(1000, 1000 + 2 * COORDINATES, dtype=np.uint64))
_FLIPS = (_SEEDS[:COORDINATES] >> np.uint64(32)).astype(np.uint32)
_FACTORS = (_SEEDS[COORDINATES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def least_matches(coordinates: int, percent: int) -> int:
    """Matches that a pair at the similarity limit reaches but for a chance of `SLACK` deviations."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - SLACK * math.sqrt(coordinates * p * (1 - p))))


def shingle_sets(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; fewer words than a shingle are one."""
    n = len(words) - SHINGLE + 1
    rolling = np.zeros(0, np.uint64)
    if n > 0:
        rolling = words[:n] * _WORD_FACTORS[0]
        for j in range(1, SHINGLE):
            rolling += words[j : n + j] * _WORD_FACTORS[j]
        rolling = mix(rolling)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(rolling[a : b - SHINGLE + 1])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            sets.append(mix((words[a:b] * _WORD_FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(rolling[:0])
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Row per set (none empty), column per coordinate: the smallest value of its hash function."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat((flat ^ _FLIPS[k]) * _FACTORS[k], starts)
    return out


def _binaries(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Back from binary values of one width."""
    if not len(column):
        return np.zeros((0, COORDINATES), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id`, `text_hash`, `n_shingles`, `node` (hash of the set, null if empty), `signature`."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, text_hash long, n_shingles long, node long, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, bounds in hashed_words(batch["text"], SPACED):
                sets = shingle_sets(words, bounds)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                nodes = [hashlib.blake2b(s, digest_size=8).digest() if len(s) else bytes(8) for s in sets]
                nodes = pa.array(np.frombuffer(b"".join(nodes), np.int64), mask=sizes == 0)
                found = signatures([sets[i] for i in full]) if len(full) else np.zeros((0, COORDINATES), np.uint32)
                place = np.cumsum(sizes > 0) - 1
                signed = _binaries(found).take(pa.array(place, mask=sizes == 0))
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own["id"], own["text_hash"], pa.array(sizes), nodes, signed], ["id", "text_hash", "n_shingles", "node", "signature"])

    return text_batches(rows).mapInArrow(run, schema)


def _posting_hashes(signature: np.ndarray) -> np.ndarray:
    coordinate = np.arange(signature.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(signature.astype(np.uint64) | coordinate)


def _bucket(postings: np.ndarray) -> np.ndarray:
    return (postings & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(classes: DataFrame) -> np.ndarray:
    """How many postings of all classes fall into each hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(_bucket(_posting_hashes(_matrix(batch["signature"], np.uint32))).ravel(), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    found = classes.select("signature").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def rarest_postings(classes: DataFrame, posted: int) -> DataFrame:
    """`posting`, `node`: the rarest coordinate-value pairs of each class, in one order for all."""
    counts = classes.sparkSession.sparkContext.broadcast(bucket_counts(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            postings = _posting_hashes(_matrix(batch["signature"], np.uint32))
            order = np.lexsort((postings, counts.value[_bucket(postings)]), axis=-1)[:, :posted]
            rare = np.take_along_axis(postings, order, 1).view(np.int64).ravel()
            nodes = np.repeat(batch["node"].to_numpy(), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(rare), pa.array(nodes)], ["posting", "node"])

    return classes.select("node", "signature").mapInArrow(run, "posting long, node long")


def shared_lists(postings: DataFrame) -> DataFrame:
    """`posting`, `node`, `members` of the lists with two members or more; one list of those with the same members."""
    about = postings.groupBy("posting").agg(F.count("*").alias("members"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
    chosen = about.where("members > 1").groupBy("members", "x", "y").agg(F.min("posting").alias("posting"))
    return postings.join(stored(chosen.select("posting", "members"), "lists"), "posting")


def in_block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Adds `i` <= `j`: rows of a group, dealt into blocks by node, once for every pair with their block."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in which these are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(near: Callable, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest; near(i, others) says which of the others are linked with i.

    Every node is compared with those that no earlier node has reached.
    """
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            linked = near(i, rest)
            reached = rest[linked]
            edges += [(i, int(j)) for j in reached]
            queue += reached.tolist()
            rest = rest[~linked]
    return edges


def _edge_batch(nodes: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])


def candidate_pairs(lists: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """`a`, `b`: a forest of the pairs in each list that agree in `matches` coordinates and fit in size."""
    members = lists.join(classes.select("node", "n_shingles", "signature"), "node")
    members = in_block_pairs(members, F.ceil(F.col("members") / LIST_BLOCK))
    keys = ["posting", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            nodes, sizes = group["node"].to_numpy(), group["n_shingles"].to_numpy()
            signed = _matrix(pa.concat_arrays(group["signature"].chunks), np.uint32)

            def near(i: int, others: np.ndarray) -> np.ndarray:
                small, large = np.minimum(sizes[i], sizes[others]), np.maximum(sizes[i], sizes[others])
                return (100 * small >= percent * large) & ((signed[others] == signed[i]).sum(1) >= matches)  # noqa: B023

            if edges := _forest(near, len(nodes)):
                yield _edge_batch(nodes, edges)

    dealt = members.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "node", "n_shingles", "signature").mapInArrow(run, "a long, b long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over shingles that two sets hold or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    held = np.bincount(number)
    shared = held[number] > 1
    owner, number = owner[shared], (np.cumsum(held > 1) - 1)[number[shared]]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, SLAB):
        a, b = np.searchsorted(number, (start, start + SLAB))
        hold = np.zeros((len(sets), min(SLAB, int(number[b - 1]) + 1 - start)), np.float32)
        hold[owner[a:b], number[a:b] - start] = 1
        common += hold @ hold.T
    return common


def confirmed_links(families: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """`a`, `b`: a forest of the links of each family, confirmed on full sets.

    families: `id`, `text_hash`, `node`, `family`, `members`, `shingles` (of the family).
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    chosen = texts.join(families, texts["doc"].eqNullSafe(families["id"]) & (texts["hash"] == families["text_hash"]))
    chosen = chosen.select("node", "family", "members", "shingles", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, bounds in hashed_words(batch["text"], SPACED):
                own = batch.slice(first, last - first).drop_columns(["text"])
                yield own.append_column("shingle_set", pa.array([s.tobytes() for s in shingle_sets(words, bounds)], pa.binary()))

    chosen = text_batches(chosen).mapInArrow(sets, "node long, family long, members long, shingles long, shingle_set binary")
    blocks = F.greatest(F.ceil(F.col("members") / FAMILY_BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    keys = ["family", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
            held = [np.frombuffer(group["shingle_set"][int(i)].as_buffer(), np.uint64) for i in first]
            common, sizes = _common(held), np.array([len(s) for s in held])
            linked = 100 * common >= percent * (sizes[:, None] + sizes - common)
            if edges := _forest(lambda i, others: linked[i, others], len(nodes)):  # noqa: B023
                yield _edge_batch(nodes, edges)

    dealt = in_block_pairs(chosen, blocks).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "node", "shingle_set").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: `id`, `text_hash`, `n_shingles`, `root`, `component_id`, `kept`.

    root names the component (null without shingles). Texts are linked when their shingle sets share percent of their union or more. component_id is the
    smallest id reachable over links; a null id is larger than any other. A null or empty text, or one
    of white space, has no shingles and no links. Rows with equal sets are linked whatever their ids;
    repeated rows are marked alike. An empty table gives an empty result. Other columns are not read.

    A node is a 64-bit hash of the set; two different sets have one hash with a chance of 2^-64.
    """
    sketches = stored(sketch(docs, id_col, text_col), "sketches")
    classes = sketches.where("n_shingles > 0").select("id", "text_hash", "node", "n_shingles", "signature").dropDuplicates(["node"])
    classes = stored(classes, "classes")
    matches = least_matches(COORDINATES, percent)
    postings = stored(rarest_postings(classes, COORDINATES - matches + 1), "postings")
    pairs = stored(candidate_pairs(shared_lists(postings), classes, matches, percent), "pairs")
    links = None
    if not pairs.isEmpty():
        families = stored(components(pairs), "families").withColumnRenamed("component", "family")
        members = families.join(classes.select("id", "text_hash", "node", "n_shingles"), "node")
        members = stored(members, "members")
        sizes = stored(members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")), "sizes")
        links = stored(confirmed_links(members.drop("n_shingles").join(sizes, "family"), docs, id_col, text_col, percent), "links")
    rows = sketches.select("id", "text_hash", "n_shingles", "node")
    if links is not None and not links.isEmpty():
        rows = rows.join(stored(components(links), "components"), "node", "left")
        rows = rows.withColumn("root", F.coalesce("component", "node")).drop("component")
    else:
        rows = rows.withColumn("root", F.col("node"))
    groups = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").drop("n").withColumnRenamed("root", "of"), "groups")
    rows = rows.join(groups, rows["root"] == groups["of"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("least")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select("id", "text_hash", "n_shingles", "root", "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each component, the smallest id.

    Where several rows tie for the smallest id, the one with the smallest text hash stays, of repeated
    rows one. Only components of two rows and more are joined with docs.
    """
    found = stored(near_duplicates(docs, id_col, text_col, percent).where("root IS NOT NULL").select("root", "id", "text_hash"), "found")
    texts = found.groupBy("root", "id", "text_hash").agg(F.count("*").alias("repeats"))
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("text_hash"))
    first = texts.groupBy(F.col("root").alias("of")).agg(F.min(order).alias("first"), F.sum("repeats").alias("rows"))
    first = stored(first.where("rows > 1").drop("rows"), "first")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    judged = texts.join(first, F.col("root") == F.col("of")).select("id", F.col("text_hash").alias("hash"), stays.alias("stays"), "repeats")
    return drop_judged(docs, id_col, F.xxhash64(text_col), judged)

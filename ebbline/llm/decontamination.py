"""Benchmark decontamination by an FM-index per shard of training documents.

A shard is a run of whole documents of about `SHARD_WORDS` words. Its words are numbered, its suffixes
sorted, and its Burrows-Wheeler transform kept as a wavelet matrix. Windows of benchmark items are
found by backward search, all windows of a shard at once; their places come from sampled suffix
positions. The hit words of a document are merged into spans.

The windows are sent to the tasks in blocks of at most `WINDOWS_PER_PASS`; a larger benchmark takes
more passes over the documents, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import quoted, stored, text_batches
from ebbline.llm.text_arrays import LETTERS, hashed_words, utf8, word_spans

#: Fixed value: words of a window.
WINDOW = 10
SHARD_WORDS = 1 << 18
#: Windows of one pass: 80 bytes each, so 16 MB are broadcast at most.
WINDOWS_PER_PASS = 200_000
#: Every so many positions of the text the suffix table keeps one.
SAMPLED = 8

ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS w, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, lens WHERE len(ws) >= n)),
found AS (SELECT pos.doc_id, pos.p, pos.n, win.item_id FROM pos JOIN win ON pos.w = win.w AND pos.n = win.n),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


class WaveletMatrix:
    """Rank and access over numbers below 2 ** levels, one sorted-by-bit level for each bit."""

    def __init__(self, values: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value occurs among the first upto values."""
        start = np.zeros(len(value), np.int64)
        upto = upto.astype(np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (value >> (self.levels - 1 - i)) & 1 == 1
            a, b = ones[start], ones[upto]
            start, upto = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, upto - b)
        return upto - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return value


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; symbols are numbers from 0.

    The first sort takes as many symbols as fit into 62 bits. After that only suffixes that still tie
    are sorted again, by the rank of what follows at twice the depth.
    """
    n = len(symbols)
    # 0 is kept for the end of the shard, so every symbol is raised by one.
    width = (int(symbols.max()) + 1).bit_length() if n else 1
    depth = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for j in range(min(depth, n)):
        key <<= width
        key[: n - j] += symbols[j:] + 1
    order = np.argsort(key)
    sorted_keys = key[order]
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, n])
    rank[order] = np.repeat(head, size)
    tied = np.repeat(size > 1, size)
    places = np.flatnonzero(tied)
    while len(places):
        # Places of one group are neighbours; the group's number is its first place.
        suffixes = order[places]
        group = rank[suffixes]
        after = suffixes + depth
        following = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(group * (n + 1) + following)
        suffixes, group, following = suffixes[again], group[again], following[again]
        order[places] = suffixes
        new = np.r_[True, (group[1:] != group[:-1]) | (following[1:] != following[:-1])]
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, len(places)])
        rank[suffixes] = np.repeat(places[head], size)
        places = places[np.repeat(size > 1, size)]
        depth *= 2
    return order


class FMIndex:
    """Backward search over the words of a shard of documents.

    words: hashes of all words; bounds: first word of each document, and the number of words. After
    each document stands a separator of its own, smaller than all words, so nothing matches across.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n_docs = len(bounds) - 1
        self.names, numbers = np.unique(words, return_inverse=True)
        of_doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        n = len(words) + n_docs
        symbols = np.empty(n, np.int64)
        symbols[np.arange(len(words)) + of_doc] = numbers + n_docs
        ends = bounds[1:] + np.arange(n_docs)
        symbols[ends] = np.arange(n_docs)
        starts = bounds[:-1] + np.arange(n_docs)
        order = sort_suffixes(symbols)
        # All separators are one symbol from here on: no search and no walk crosses them.
        symbols = np.maximum(symbols - (n_docs - 1), 0)
        self.smaller = np.zeros(len(self.names) + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=len(self.names) + 1), out=self.smaller[1:])
        self.transform = WaveletMatrix(symbols[order - 1], len(self.names))
        sampled = order % SAMPLED == 0
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        sampled |= is_start[order]
        self.sampled = sampled
        self.before = np.zeros(n + 1, np.int32)
        np.cumsum(sampled, out=self.before[1:])
        self.positions = order[sampled]
        self.separators = np.cumsum(np.bincount(ends, minlength=n)) if n else np.zeros(0, np.int64)
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each phrase (rows of word hashes, filled at the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        if not len(self.names):
            return low, low
        numbers = np.minimum(np.searchsorted(self.names, phrases), len(self.names) - 1)
        used = np.arange(phrases.shape[1]) < lengths[:, None]
        known = ((self.names[numbers] == phrases) | ~used).all(1) & (lengths > 0)
        high[~known] = 0
        for j in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero(used[:, j] & (low < high))
            if len(at):
                symbol = numbers[at, j] + 1
                low[at] = self.smaller[symbol] + self.transform.rank(symbol, low[at])
                high[at] = self.smaller[symbol] + self.transform.rank(symbol, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word positions (separators not counted) of suffix rows, walking back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            symbol = self.transform.access(rows[open_])
            rows[open_] = self.smaller[symbol] + self.transform.rank(symbol, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        at = self.positions[self.before[rows]] + steps
        return at - self.separators[at]


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: `item` (as string), `words` (hashes as a list of long).

    An item of fewer than `WINDOW` words is one window; an item without words or text has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words, bounds in hashed_words(batch["text"], LETTERS):
                n = np.diff(bounds)
                counts = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)
                of = np.repeat(np.arange(last - first), counts)
                start = bounds[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                length = np.minimum(n[of], WINDOW)
                flat = words[np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(length)].astype(np.int32), flat.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(of + first)), lists], ["item", "words"])

    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "item string, words array<long>").distinct()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Whole documents of about SHARD_WORDS words: rows, word hashes, first words."""
    rows: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    n = 0

    def shard() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(rows)
        bounds = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)
        found = table, np.concatenate(parts), bounds
        rows.clear(), parts.clear(), counts.clear()
        return found

    for batch in batches:
        for first, last, words, bounds in hashed_words(batch["text"], LETTERS):
            if n and n + len(words) > SHARD_WORDS:
                yield shard()
                n = 0
            rows.append(batch.slice(first, last - first))
            parts.append(words)
            counts.append(np.diff(bounds))
            n += len(words)
    if rows:
        yield shard()


def _phrases(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Word hashes of each window (filled at the right), lengths, first item of each window, item numbers, item names."""

    def flat(name: str) -> tuple[np.ndarray, pa.Array]:
        lists = found[name].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        return np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64), lists.flatten()

    starts, words = flat("words")
    lengths = np.diff(starts)
    phrases = np.zeros((len(lengths), WINDOW), np.uint64)
    phrases[np.arange(WINDOW) < lengths[:, None]] = words.to_numpy().view(np.uint64)
    first, items = flat("items")
    items = items.to_pylist()
    names = sorted(set(items))
    number = {x: i for i, x in enumerate(names)}
    return phrases, lengths, first, np.array([number[x] for x in items], np.int64), names


def _search_shard(
    table: pa.Table, words: np.ndarray, bounds: np.ndarray, phrases: np.ndarray, lengths: np.ndarray, first: np.ndarray, items: np.ndarray
) -> tuple:
    """Per document: hit flags of its words (flat), and (document, item) pairs."""
    index = FMIndex(words, bounds)
    low, high = index.search(phrases, lengths)
    many = high - low
    phrase = np.repeat(np.arange(len(phrases)), many)
    rows = np.repeat(low, many) + np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
    change = np.zeros(len(words) + 1, np.int64)
    found = np.zeros((0, 2), np.int64)
    for i in range(0, len(rows), SHARD_WORDS):
        at = index.locate(rows[i : i + SHARD_WORDS])
        own = phrase[i : i + SHARD_WORDS]
        np.add.at(change, at, 1)
        np.add.at(change, at + lengths[own], -1)
        docs = np.searchsorted(bounds, at, "right") - 1
        found = np.unique(np.concatenate([found, np.stack([docs, own], 1)]), axis=0)
    # Places are located once a window; its items follow per document that has it.
    many = np.diff(first)[found[:, 1]]
    place = np.repeat(first[found[:, 1]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pairs = np.unique(np.stack([np.repeat(found[:, 0], many), items[place]], 1), axis=0)
    if "spans" in table.column_names:
        # Runs found by an earlier pass.
        lists = table["spans"].combine_chunks()
        start = np.repeat(bounds[:-1], pa.compute.list_value_length(lists).to_numpy())
        np.add.at(change, start + lists.flatten().field("first").to_numpy(), 1)
        np.add.at(change, start + lists.flatten().field("last").to_numpy(), -1)
    return np.cumsum(change)[:-1] > 0, pairs


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    clean: bool = False,
    windows_per_pass: int = WINDOWS_PER_PASS,
) -> DataFrame:
    """One row per row of docs: `id`, `n_words`, `n_hit`, `items`, `spans`, and the carried columns.

    A word is hit when it lies in an occurrence of a window; `spans` has the runs of hit words as
    first word and last word + 1; `items` the ids (as strings) of the items with windows found, sorted,
    null ids left out. A text without words, empty or null, has no hits. An empty benchmark hits
    nothing, an empty docs gives an empty result. Repeated rows are judged alike. Other columns of
    docs are not read, whatever their names. `carry` maps names to expressions over docs. With `clean`
    the column `clean` has the text without its spans (null stays null).
    """
    # Stages in Python look columns up by name, so they get names without special characters.
    carried = [c.alias(f"carry_{i}") for i, c in enumerate((carry or {}).values())]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    all_windows = stored(windows(benchmark), "windows")
    passes = max(1, -(-all_windows.count() // windows_per_pass))
    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.drop("text").schema]
    kinds += ["n_words long", "n_hit long", "items array<string>", "spans array<struct<first: long, last: long>>"]
    for number in range(passes):
        # Dealt by window and item: one window of very many items is spread over the passes as well.
        mine = all_windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(passes)) == number)
        # Null items are left out of the lists, their windows are searched all the same.
        mine = mine.groupBy("words").agg(F.collect_list("item").alias("items"))
        sent = rows.sparkSession.sparkContext.broadcast(_phrases(mine.toArrow()))
        # What earlier passes found travels with the row; the text goes along until the last one.
        is_last = number == passes - 1
        text = ["clean string"] if is_last and clean else [] if is_last else ["text string"]
        rows = text_batches(rows).mapInArrow(_pass(sent, is_last, clean), ", ".join([*kinds, *text]))
    return rows.withColumnsRenamed({f"carry_{i}": name for i, name in enumerate(carry or {})})


def _pass(sent: Broadcast, is_last: bool, clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, lengths, first, items, names = sent.value
        for table, words, bounds in _shards(batches):
            hit, pairs = _search_shard(table, words, bounds, phrases, lengths, first, items)
            found = _rows(table, bounds, hit, pairs, names)
            if not is_last:
                found = found.append_column("text", table["text"])
            elif clean:
                found = found.append_column("clean", _without(table["text"], found["spans"]))
            yield from found.to_batches()

    return run


def _without(texts: pa.ChunkedArray, spans: pa.ChunkedArray) -> pa.Array:
    """Texts with the bytes from the first to the last word of each span taken out."""
    texts, spans = texts.combine_chunks(), spans.combine_chunks()
    cut = pa.compute.greater(pa.compute.list_value_length(spans), 0)
    out = []
    for i in np.flatnonzero(cut.to_numpy(zero_copy_only=False)):
        data, offsets = utf8(pa.array([texts[i].as_py()]))
        starts, ends, _ = word_spans(data, offsets, LETTERS)
        kept, at = [], 0
        for span in spans[i].as_py():
            kept.append(data[at : starts[span["first"]]].tobytes())
            at = ends[span["last"] - 1]
        out.append(b"".join([*kept, data[at:].tobytes()]).decode())
    return pa.compute.replace_with_mask(texts, cut, pa.array(out, pa.string())) if out else texts


def _rows(table: pa.Table, bounds: np.ndarray, hit: np.ndarray, pairs: np.ndarray, names: np.ndarray) -> pa.Table:
    n = len(bounds) - 1
    total = np.r_[0, np.cumsum(hit)]
    edge = np.diff(np.r_[False, hit, False].astype(np.int8))
    # Runs end with their document.
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.unique(bounds)
    cut = cut[(cut > 0) & (cut < len(hit))]
    cut = cut[hit[cut - 1] & hit[cut]] if len(cut) else cut
    opens, closes = np.sort(np.r_[opens, cut]), np.sort(np.r_[closes, cut])
    # The last of empty documents that start at one word holds it.
    of = np.searchsorted(bounds, opens, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(opens - bounds[of]), pa.array(closes - bounds[of])], ["first", "last"])
    span_bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    item_bounds = np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32)
    own = [names[i] for i in pairs[:, 1]]
    items = [own[a:b] for a, b in zip(item_bounds, item_bounds[1:], strict=False)]
    if "items" in table.column_names:
        items = [sorted({*a, *b}) for a, b in zip(items, table["items"].to_pylist(), strict=True)]
    out = table.drop_columns([c for c in ("text", "n_words", "n_hit", "items", "spans") if c in table.column_names])
    out = out.append_column("n_words", pa.array(np.diff(bounds)))
    out = out.append_column("n_hit", pa.array(np.diff(total[bounds])))
    out = out.append_column("items", pa.array(items, pa.list_(pa.string())))
    return out.append_column("spans", pa.ListArray.from_arrays(span_bounds, spans))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns; benchmark passages are cut out of the texts.

    `n_chars`, where docs have it, is counted anew for the texts that were cut. A document whose words
    were all benchmark passages is dropped; a document that had no words before stays.
    """
    carry = {c: quoted(c) for c in docs.columns if c != text_col}
    found = find_spans(docs, benchmark, id_col, text_col, {f"own_{c}": x for c, x in carry.items()}, clean=True)
    found = found.where("n_hit = 0 OR n_hit < n_words")
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("n_hit") > 0, F.char_length("clean")).otherwise(F.col("own_n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(quoted(f"own_{c}").alias(c))
    return found.select(*columns)

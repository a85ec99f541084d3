"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Before any text is read, the merges are run on every string of the vocabulary alone; those that end
as one token are proven. A pre-token among them counts one; only other pre-tokens are merged, and
their counts remembered. The vocabulary bounds what is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import text_batches

#: Fixed value: the pattern by which byte-level BPE splits a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered counts of merged pre-tokens per task, and the longest pre-token that is remembered.
REMEMBERED, LONGEST = 500_000, 64
#: Symbols up to which a pre-token is merged by plain search.
SHORT = 32
_LAST = 1 << 60
_NEVER = [_LAST] * SHORT


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file (a fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when the pair of lowest rank, leftmost first, is merged until none is known.

    Short pre-tokens are searched anew for each merge; longer ones keep a heap over a linked list,
    n log n for a pre-token of n bytes.
    """
    n = len(symbols)
    if n <= SHORT:
        known = ranks.get
        while n > 1:
            best = min(zip(map(known, zip(symbols, symbols[1:], strict=False), _NEVER), range(n)))
            if best[0] == _LAST:
                break
            i = best[1]
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
            n -= 1
        return n
    following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    symbols = list(symbols)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        alive -= 1
        following[i] = k = following[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return alive


class Vocabulary:
    """Merges of a tokenizer file, its special strings, and the strings proven to be one token."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            content = f.read()
        self.digest = hashlib.sha256(content).hexdigest()
        spec = json.loads(content)
        kind, before = spec["model"]["type"], spec["pre_tokenizer"] or {}
        if kind != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{file}: only plain byte-level BPE is counted")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {tuple(m): i for i, m in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = _byte_letters()
        bytes_of = {c: b for b, c in letters.items()}
        self.one_token = set()
        for token in spec["model"]["vocab"]:
            if count_merged(list(token), self.ranks) == 1:
                try:
                    self.one_token.add(bytes(bytes_of[c] for c in token).decode("utf-8"))
                except UnicodeDecodeError:
                    pass  # part of a letter: never a whole pre-token


class Counter(dict):
    """Pre-token to number of tokens; proven strings are there from the start, others on first use."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.one_token, 1))
        self.vocabulary, self.letters, self.proven = vocabulary, _byte_letters(), len(vocabulary.one_token)
        self.find = regex.compile(PRE_TOKENS).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, pre_token: str) -> int:
        n = count_merged([self.letters[b] for b in pre_token.encode()], self.vocabulary.ranks)
        if len(pre_token) <= LONGEST and len(self) < self.proven + REMEMBERED:
            self[pre_token] = n
        return n

    def forget(self) -> None:
        """Make room: only the proven strings stay."""
        self.clear()
        self.update(dict.fromkeys(self.vocabulary.one_token, 1))

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(part))) for part in parts)


#: Counters by the file's digest: tasks of one Python worker go on with what earlier ones remembered.
_counters: dict[str, Counter] = {}


def _counter(vocabulary: Vocabulary) -> Counter:
    if vocabulary.digest not in _counters:
        _counters.clear()
        _counters[vocabulary.digest] = Counter(vocabulary)
    return _counters[vocabulary.digest]


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: `id`, `n_bytes` (UTF-8), `n_tokens`, without begin or end tokens.

    A null or empty text has 0 of both. Texts are counted whole; a special string inside a text is
    one token, as in the library's default. The file is read on the driver. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vocabulary = rows.sparkSession.sparkContext.broadcast(_vocabulary(file))
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in batches:
            if len(counter) >= counter.proven + REMEMBERED:
                counter.forget()
            texts = batch["text"]
            n_tokens = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])

    return text_batches(rows).mapInArrow(run, schema)


@cache
def _vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)

"""Periodic runs, whitening and host rules against brute force, on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import host_rules, periodic_runs, queries, whitening
from tests.llm.test_operators import SMALL, as_dicts, empty, odd, rows_of, words, SCHEMA  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Periodic runs


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute_runs(w):
    """(start, length, period) of every run, by comparing all positions for all periods."""
    found, n = [], len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if length >= max(24, 3 * p) and smallest_period(w[s : s + length]) == p:
                found.append((s, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_kept(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def periodic_texts():
    rng = random.Random(5)
    texts = []
    for n in range(0, 140, 3):
        texts.append(" ".join(rng.choice("ab") for _ in range(n)))
        texts.append(" ".join("ab"[i % 2] if rng.random() > 0.02 else "c" for i in range(n * 3)))
    for p in (1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100):
        root = [f"w{rng.randrange(9)}" for _ in range(p)]
        for times in (2.9, 3, 3.4, 8):
            run = (root * 9)[: math.ceil(p * times)]
            pad = [f"u{i}" for i in range(rng.randrange(40))]
            texts.append(" ".join(pad + run + pad[::-1]))
            texts.append(" ".join(run + run[: p // 2] + run))
    fib = ["a", "b"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    return [*texts, " ".join(fib[-1]), "x " * 1000, "x y " * 300 + "x x " * 50 + "\t\n".join("xyz" * 100)]


def local_runs(w):
    """The operator's steps without Spark: tiles, stitching by period, runs."""
    by_period = defaultdict(list)
    for p, s, e in periodic_runs.fragments(w):
        by_period[p].append((s, e))
    found = []
    for p, parts in by_period.items():
        held = []
        for s, e in sorted(parts):
            if held and s <= held[-1][1]:
                held[-1][1] = max(e, held[-1][1])
            else:
                held.append([s, e])
        found += [(s, e - s + p, p) for s, e in held if e - s + p >= max(24, 3 * p)]
    return periodic_runs.distinct_runs(found)


@pytest.mark.parametrize("text", periodic_texts())
def test_tiles_give_the_runs_of_brute_force(text):
    w = text.encode().split()
    found = local_runs(w)
    assert found == brute_runs(w)
    assert periodic_runs.kept_words(w, found) == brute_kept(w, found)


def test_random_words_of_a_small_alphabet():
    rng = random.Random(11)
    for _ in range(300):
        w = [rng.choice("aab").encode() for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):  # copy parts over, so that runs overlap
            if len(w) > 20:
                at, size = rng.randrange(len(w)), rng.randrange(1, 20)
                w[at:at] = w[at : at + size] * rng.randrange(8)
        assert local_runs(w) == brute_runs(w)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        z = periodic_runs.z_function(s, len(s))
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_fragments_of_one_word_do_not_repeat_by_period():
    """A text of one repeated word gives period 1 only; work stays near linear."""
    assert {p for p, _, _ in periodic_runs.fragments([b"x"] * 20_000)} == {1}


def test_runs_of_odd_rows(spark, odd, empty):  # noqa: F811
    extra = spark.createDataFrame(rows_of([*periodic_texts()[-3:], "a b c " * 40, "a b c " * 40], [101, 102, 103, 104, 104]), SCHEMA)
    docs = odd.unionByName(extra)
    found = defaultdict(list)
    for r in as_dicts(periodic_runs.find_runs(docs)):
        found[r["id"]].append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    expected = defaultdict(list)
    for r in docs.collect():
        w = [x.encode() for x in WORD.findall(r["text"] or "")]
        runs = brute_runs(w) if len(w) < 2_000 else []
        expected[r["doc_id"]].append((len(w), runs, b" ".join(brute_kept(w, runs)).decode()))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert periodic_runs.find_runs(empty).count() == 0


def test_fragments_are_stitched(spark):
    parts = [(1, 7, 2, 0, 10), (1, 7, 2, 10, 30), (1, 7, 2, 5, 12), (1, 7, 2, 31, 60), (1, 7, 3, 12, 14), (None, 7, 2, 0, 40), (None, 7, 2, 0, 40)]
    found = periodic_runs.stitch(spark.createDataFrame(parts, "id long, hash long, period long, start long, stop long"))
    assert {(r["id"], r["start"], r["length"], r["period"]) for r in found.collect()} == {(1, 0, 32, 2), (1, 31, 31, 2), (None, 0, 42, 2)}


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return [x.encode() for x in w]


def test_periodic_run_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in as_dicts(queries.op12_periodic_runs(spark, SMALL))}
    assert len(found) == len(docs)
    some = 0
    for d in docs:
        w = planted(d["doc_id"], d["text"])
        if len(w) > 700:
            continue
        runs, r = brute_runs(w), found[d["doc_id"]]
        some += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(brute_kept(w, runs))).hexdigest()
    assert some > 5


# Whitening


def test_cholesky_and_jacobi_match_the_library():
    rng = np.random.default_rng(3)
    for d, rank in ((1, 1), (5, 5), (8, 3), (30, 30), (64, 64)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank
        np.testing.assert_allclose(factor @ factor.T, v, atol=1e-14 * np.trace(v))
        turned = whitening.jacobi_columns(factor)
        values = np.sort((turned**2).sum(axis=0))[::-1]
        np.testing.assert_allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:rank], rtol=1e-9, atol=1e-15 * np.trace(v))
        units = turned / np.sqrt((turned**2).sum(axis=0))
        np.testing.assert_allclose(units.T @ units, np.eye(rank), atol=1e-12)


def brute_whitening(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for row in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, values[::-1], vectors_[:, ::-1].T


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    n, deviation, centred, values, units = brute_whitening([r["embedding"] for r in rows])
    by_id = {r["vec_id"]: i for i, r in enumerate(rows)}
    found = as_dicts(queries.op13_embedding_whitening(spark, SMALL))
    assert len(found) == 8 * n
    white = np.zeros((n, 8))
    for r in found:
        i, k = by_id[r["vec_id"]], r["component"] - 1
        white[i, k] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    for k in range(8):
        expected = centred @ units[k] / np.sqrt(values[k])
        sign = np.sign(expected @ white[:, k])
        np.testing.assert_allclose(white[:, k], sign * expected, atol=1e-8)


VECTORS = "vec_id long, embedding array<double>, id string, component string, vector string, n string, `a.b` string"


def vector_rows(vectors):
    return [(i, v, *["x"] * 5) for i, v in enumerate(vectors)]


def test_whitening_of_odd_vectors(spark):
    good = [[1.0, 2.0, 5.0], [2.0, 1.0, 5.0], [0.5, -3.0, 5.0], [0.5, -3.0, 5.0], [1e5, 2.25, 5.0]]
    bad = [None, [], [1.0, None, 2.0], [math.nan, 0.0, 1.0], [math.inf, 0.0, 1.0], [1.0, 2.0]]
    df = spark.createDataFrame(vector_rows([*good, *bad]), VECTORS)
    fit = whitening.fit_whitening(df)
    n, deviation, _, values, _ = brute_whitening(good)
    assert (fit.n, len(fit.eigenvalues)) == (5, 2)  # the third dimension is constant
    np.testing.assert_allclose(fit.eigenvalues, values[:2], rtol=1e-9)
    found = as_dicts(whitening.whiten(df, fit))
    assert sorted((r["id"], r["component"], r["deviation"]) for r in found) == [(i, c, deviation[i]) for i in range(5) for c in (1, 2)]
    assert whitening.identity_error(df, fit) < 1e-9
    far = spark.createDataFrame(vector_rows([*good, [1e9, 0.0, 5.0]]), VECTORS)
    assert {r["id"]: r["deviation"] for r in as_dicts(whitening.whiten(far))}[5] is None  # beyond a long
    for rows in ([], bad[:5], [[1.0, 1.0]] * 3):
        same = spark.createDataFrame(vector_rows(rows), VECTORS)
        assert whitening.whiten(same).count() == 0


def test_sums_of_large_entries_are_exact():
    rng = np.random.default_rng(1)
    for most in (2**10, 2**24, 2**40):
        y = np.floor(rng.uniform(-most, most, size=(700, 3)))
        sums, gram = whitening._products(y)
        whole = [[int(v) for v in row] for row in y]
        assert list(sums) == [sum(c) for c in zip(*whole)]
        assert gram.tolist() == [[sum(r[i] * r[j] for r in whole) for j in range(3)] for i in range(3)]


# Host rules


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def brute_failed(m):
    base = [m["n_words"] < 10, 100 * m["n_repeat_words"] > 20 * m["n_words"]]
    other = [10 * m["n_symbols"] > m["n_words"], 10 * m["n_dup_lines"] > 3 * m["n_lines"], m["word_chars"] < 3 * m["n_words"], m["word_chars"] > 12 * m["n_words"]]
    return any(base), any(other)


def brute_rates(hosts):
    """Shrunk rates from {host: (n, k)}."""
    docs, failed, h = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values()), len(hosts)
    mean = failed / docs
    spread = sum(n * (k / n - mean) ** 2 for n, k in hosts.values())
    chance = mean * (1 - mean)
    room = chance * (docs - sum(n * n for n, _ in hosts.values()) / docs - (h - 1))
    within = (spread - chance * (h - 1)) / room if room > 0 else 0
    strength = 1 / min(max(within, 1e-6), 0.999999) - 1
    return {x: (k + mean * strength) / (n + strength) for x, (n, k) in hosts.items()}


def host_texts():
    texts = odd_like = [None, "", "one two", "a b c d e " * 9, "same line here\n" * 5 + words(1, 30), "\n\n x \n y\n x \n", words(7, 50), "# $ % & " + words(8, 20), "é ß x " + words(9, 12)]
    rng = random.Random(4)
    for i in range(60):
        texts = [*texts, words(100 + i, rng.randrange(8, 60)), " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))]
    return [*texts, *odd_like[:3], words(3, 30_000), words(3, 3_000) * 3]


def test_hosts_match_brute_force(spark, odd, empty):  # noqa: F811
    texts = host_texts()
    rows = rows_of(texts)
    # A host of bad documents, one of one document, and no host at all.
    hosts = ["bad" if t is None or len(set(t.split())) < 9 else ["a", "b", None][i % 3] for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r[:3], h, *r[4:]) for r, h in zip(rows, [*hosts[:-1], "single"], strict=True)], SCHEMA).unionByName(odd)
    plain = docs.collect()
    measured = [brute_measures(r["text"]) for r in plain]
    failed = [brute_failed(m) for m in measured]
    counts = defaultdict(lambda: (0, 0))
    for r, f in zip(plain, failed):
        n, k = counts[r["source"]]
        counts[r["source"]] = (n + 1, k + any(f))
    rates = brute_rates(counts)
    verdicts = {h: "rejected" if x >= 0.6 else "watched" if x >= 0.3 else "trusted" for h, x in rates.items()}
    assert {"rejected", "watched"} <= set(verdicts.values())
    expected = []
    for r, m, (base, other) in zip(plain, measured, failed):
        verdict = verdicts[r["source"]]
        kept = not base and verdict != "rejected" and (verdict == "trusted" or not other)
        expected.append(str((r["doc_id"], r["source"], *m.values(), base, verdict, kept)))
    found = as_dicts(host_rules.judge_by_host(docs))
    names = ["id", "host", *measured[0], "base_failed", "host_verdict", "kept"]
    assert sorted(str(tuple(r[c] for c in names)) for r in found) == sorted(expected)
    for r in found:
        if r["host_verdict"] != "trusted":
            assert abs(r["host_rate"] - rates[r["host"]]) < 1e-12
    assert host_rules.judge_by_host(empty).count() == 0


def test_small_hosts_are_drawn_to_the_mean(spark):
    hosts = {f"h{i}": (100, 5 + i) for i in range(20)} | {"one": (1, 1), "many": (1_000, 400)}
    found = host_rules.host_rates(spark.createDataFrame([(h, n, k) for h, (n, k) in hosts.items()], "host string, n long, k long"))
    rates = {r["host"]: r["shrunk_rate"] for r in found.collect()}
    assert rates == pytest.approx(brute_rates(hosts), rel=1e-9)
    assert rates["many"] > 0.39 and rates["one"] < 0.5


def test_equal_rates_are_all_prior(spark):
    hosts = {"a": (10, 0), "b": (1_000, 0)}
    found = host_rules.host_rates(spark.createDataFrame([(h, n, k) for h, (n, k) in hosts.items()], "host string, n long, k long"))
    assert [r["shrunk_rate"] for r in found.collect()] == [0.0, 0.0]


def test_host_rules_query_has_no_python(spark):
    judged = queries.op11_host_rules(spark, SMALL)
    assert judged.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    measured = spark.range(1).select(F.to_json(host_rules.measures(F.lit("a b c d e a b c d e")))).first()[0]
    assert '"n_repeat_words":10' in measured

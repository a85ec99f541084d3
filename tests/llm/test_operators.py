"""The dealt operators against brute force, the library, or a round trip, on odd tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm import decontamination, exact_dedup, language_model, main_text, mixing, near_dedup, quality, queries, token_counts, url_filter, warc
from ebbline.llm.components import components
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
#: Columns of other meaning under the names the operators use.
CLASHES = ["id", "text_hash", "hash", "node", "kept", "keep_id", "n_words", "spans", "items", "clean", "component_id", "root", "label", "size", "key", "range", "copies", "repeats", "stays", "quality_score", "length", "prefix", "content"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(vocabulary)) for _ in range(n))


def rows_of(texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", f"src{(i or 0) % 3}" if i != 5 else None, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in zip(ids, texts, strict=True)]


def odd_texts():
    base = words(1, 120)
    changed = base.split()
    changed[60] = "other"
    far = base.split()
    far[10::20] = ["new"] * len(far[10::20])
    return [
        None,
        "",
        " \t\n",
        "one",
        "One",
        "one two three four",
        base,
        base,
        base.upper(),
        " ".join(changed),
        " ".join(far),
        base + " tail",
        words(2, 30_000),
        words(2, 30_000) + " more",
        "same same same " * 400,
        "é ß\x00 x\u00a0y 'S <|endoftext|> it's",
        words(3, 9),
        None,
        "",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, repeated rows, a null id and clashing columns."""
    texts = odd_texts()
    rows = rows_of(texts) + rows_of([texts[6], texts[6], words(4, 50), words(4, 50), "one"], [6, 30, None, None, 3])
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_main_text_of_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><h2>Site</h2></header>
    <div id="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav><div class=x><main><article><header><h1>Head &amp; line</h1></header>
    <p>One.<p>Two <a href="y>z">link</a>   more&nbsp;&#x41;<br>x<p>Three</p><script>var a="</p>";</script><aside class="sidebar">Related</aside>
    <div class="ad">Buy</div><ul><li>a<li>b</ul><form><input>Sign up</form><section id="comments"><article><p>First!</p></article></section>
    </article></main></div><footer>F</footer>"""
    assert main_text.main_text(page) == "Head & line\nOne.\nTwo link more A x\nThree\na\nb"
    body = "A sentence that goes on for a while, as those of an article do on most pages."
    plain = f"<body><nav><a>Home</a><a>More</a></nav><div>{body}</div><div>{body}</div><div class=comments>{body} no</div><div><a href=a>Next</a></div>"
    assert main_text.main_text(plain) == f"{body}\n{body}"
    for nothing in (None, "", " ", "<p", "<!--", "<script>x", "<nav>menu"):
        assert main_text.main_text(nothing) == ""
    assert main_text.main_text("plain text") == "plain text"
    assert main_text.main_text("<p>" + "long " * 200_000) == ("long " * 200_000).strip()


def test_main_text_weighs_an_article_by_density():
    body = "A sentence that goes on for a while, as those of an article do on most pages."
    links = "".join(f"<li><a href=x>Another page with a long title {i}</a></li>" for i in range(9))
    page = f"<article><h1><a href=x>Head</a></h1><p>{body}</p><p><a href=x>Source</a></p><p>{body} <a href=x>one</a></p><ul>{links}</ul><p>End.</p></article>"
    # Lists of links in an article stay, as does dense text outside of it.
    sources = "\n".join(f"Another page with a long title {i}" for i in range(9))
    assert main_text.main_text(page + f"<div>{body} out</div>") == f"Head\n{body}\nSource\n{body} one\n{sources}\nEnd.\n{body} out"
    assert main_text.main_text(page + "<p>Written by the staff of the paper, printed in some town.</p>") == f"Head\n{body}\nSource\n{body} one\n{sources}\nEnd."
    assert main_text.main_text("<article><p>Short.</p></article><p>Copyright 2024 A. Publisher, Inc.</p>") == "Short."
    assert main_text.main_text("<article><p><a href=x>All linked</a></p></article>") == "All linked"


def test_main_text_is_not_lost_by_a_word():
    body = "A sentence that goes on for a while, as those of an article do on most pages. " * 4
    text = body.strip()
    blocks = f"<div><p>{body}</p></div><div><p>{body}</p></div>"
    teaser = "<article><h2>Teaser</h2></article>"
    for page in (
        f"<main></main>{blocks}",
        f"{blocks}<div class=related>{teaser}</div>",
        *(f'<div class="{c}">{blocks}</div>' for c in ("content has-sidebar", "no-sidebar", "content sidebar", "widget")),
        f"<div class=widget>{blocks}<div class=ad>{text[:80]}</div><div class=comments><div class=reply><p>{body} {body} {body}</p></div></div></div>",
        f'<article class="post category-social tag-search">{blocks}</article>',
        f"{blocks}<div class=comments><p>{body} no</p><p>{body} no</p><p>{body} no</p></div>",
        f"{blocks}<div class='main-nav site-menu'>Home or away</div><p class=cookie-notice>{text[:80]}</p><div role=search aria-label='Site search'>Find it</div>",
    ):
        assert main_text.main_text(page) == f"{text}\n{text}"
    assert main_text.main_text(f"{teaser}{blocks}") == f"Teaser\n{text}\n{text}"
    page = f"<article><p>{body}</p><h2 id=related-work>Related work</h2><p>{body}</p><section id=discussion><h2 class=header>Discussion</h2><p>{body}</p></section></article>"
    assert main_text.main_text(page) == f"{text}\nRelated work\n{text}\nDiscussion\n{text}"


def test_main_text_ends_controls_and_keeps_short_blocks():
    long = "A sentence that goes on for a while, as those of an article do on most pages. " * 3
    text = long.strip()
    cases = {
        "<article><h1>T</h1><button>Share</button><p>One.</p><p>Two.</p></article>": "T\nOne.\nTwo.",
        "<article><p>a<button>Share<p>One.</p><label>x<p>Two.</p></article>": "a\nOne.\nTwo.",
        "<div><select><option>a<option>b</select><p>One two.</p></div>": "One two.",
        "<div><datalist id=d><option>a</option></datalist><p>One two.</p></div>": "One two.",
        "x <label>y</label> z": "x z",
        "x <label>y <button><b>q</b></button> <input> y</label> z": "x z",
        "x <label>y <label>y</label> z": "x z",
        "<p>One.</p><button>lost to the end": "One.",
        "<article><p>Short one.</p><p>Two.</p></article><section class=comments><p>" + long + "</p></section>": "Short one.\nTwo.",
        "<section class=comments><p>" + long + "</p></section>": "",
        f"<div><p>{long}</p><p>Yes.</p><p>No.</p><p>Ok.</p><p>Hm.</p><p>{long}</p></div>": f"{text}\nYes.\nNo.\nOk.\nHm.\n{text}",
        f"<h1>Head</h1><div class=widget><p>{long}</p></div><div class=related>Too</div>": f"Head\n{text}",
    }
    for page, expected in cases.items():
        assert main_text.main_text(page) == expected, page


def test_main_text_of_random_pages():
    """Pages written from blocks known to be text or not; the expected text comes from the writer alone."""
    rng = random.Random(5)
    words = "amber birch cedar delta ember fjord grove haven".split()

    def some(least, most):
        return " ".join(rng.choices(words, k=rng.randint(least, most)))

    def block(inside):
        """Markup and its lines of text."""
        kind, t = rng.randrange(12), some(1, 30)
        if kind < 4:
            return f"<p>{t}</p>", [t]
        if kind == 4:
            cut = some(1, 3)
            return f"<div><p>{t} <!-- <p>no --><b>{cut}</b>\n &amp; <i>x</i></p></div>", [f"{t} {cut} & x"]
        if kind == 5:
            items = [some(1, 5) for _ in range(rng.randint(1, 6))]
            return "<ul>" + "".join(f"<li><a href='/x'>{i}</a></li>" for i in items) + "</ul>", items if inside else []
        if kind == 6:
            name = rng.choice(["button", "label", "select", "datalist"])
            return f"<p>{t} <{name} class=x>{some(1, 9)}</{name}> end</p>", [f"{t} end"]
        if kind == 7:
            name = rng.choice(["nav", "aside", "form", "footer", "menu", "fieldset", "dialog"])
            return f"<{name}><div>{some(1, 40)}</div><p>{some(1, 40)}</{name}>", []
        if kind == 8:
            return f"<div class='{rng.choice(['ad', 'cookie-notice', 'comments', 'newsletter'])}'><p>{some(1, 60)}</p></div>", []
        if kind == 9:
            return f"<script>var a = '<p>{t}</p>';</script><style>p {{}}</style>", []
        if kind == 10:
            return f"<button>{some(1, 4)}<p>{t}</p>" if inside else f"<p>{t}</p>", [t]
        return f"<h2>{t}</h2>", [t]

    for _ in range(400):
        inside = rng.random() < 0.7
        opening = some(1, 30)
        parts = [(f"<p>{opening}</p>", [opening]), *(block(inside) for _ in range(rng.randint(0, 14)))]
        if not inside:
            # Without an article the long paragraphs at both ends bound the text, and no list of links stands between.
            ends = [(f"<p>{x}</p>", [x]) for x in (some(20, 30), some(20, 30))]
            parts = [ends[0], *(x for x in parts if "<ul>" not in x[0]), ends[1]]
        page = "".join(markup for markup, _ in parts)
        page = f"<nav>{some(1, 9)}</nav>" + (f"<article>{page}</article>" if inside else page) + f"<footer>{some(1, 9)}</footer>"
        assert main_text.main_text(page) == "\n".join(line for _, found in parts for line in found), page


def test_main_text_of_tables(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "u", "<p>" + "long " * 300_000, "y"), (None, "u", "", "z"), (2, "u", "<p>a.b", "y")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string").withColumn("text", F.lit("other")).withColumn("id", F.lit(7))
    got = sorted(((r.id or 0, r.n_chars, r.text[:3]) for r in main_text.extract(table).collect()))
    assert got == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 3, "a.b"), (2, 1_499_999, "lon")]
    assert main_text.extract(table.limit(0)).collect() == []


def test_main_text_stretches():
    lengths = np.array([0, 0, 50, 0, 0, 0, 0, 60, 5, 60, 0, 0, 0, 3])
    assert main_text.stretches(lengths, 20) == [(2, 3), (7, 10)]
    assert main_text.stretches(lengths, 0.0) == [(2, 3), (7, 10), (13, 14)]
    assert main_text.stretches(np.zeros(0, int), 0.0) == []


def test_main_text_query_matches_the_article(spark):
    for r, page in zip(
        sorted(queries.op1_main_text(spark, SMALL).collect()), sorted(queries.read(spark, SMALL, "pages").collect()), strict=True
    ):
        article = page.html.partition("<article>")[2].partition("</article>")[0]
        blocks = __import__("re").split(r"</?(?:h1|p)>", article)
        text = [__import__("html").unescape(__import__("re").sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in blocks]
        assert r.text == "\n".join(" ".join(t.split()) for t in text if t.split())
        assert r.n_chars == len(r.text)


def test_token_counts_match_the_library(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(file)
    for docs in (odd, queries.read(spark, SMALL, "documents")):
        text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
        for r in token_counts.count_tokens(docs, file).collect():
            if r.id is not None:
                assert r.n_tokens == len(own.encode(text[r.id], add_special_tokens=False).ids)
                assert r.n_bytes == len(text[r.id].encode())
    assert token_counts.count_tokens(empty, file).count() == 0


def test_merges_of_short_and_long_pre_tokens_agree():
    import public_tokenizers

    vocabulary = token_counts.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(300):
        symbols = [rng.choice("etaoinsrhlĠ") for _ in range(rng.randrange(1, token_counts.SHORT + 1))]
        short = token_counts.count_merged(symbols, vocabulary.ranks)
        # The heap is used from SHORT symbols on: a part that merges with nothing makes the word long.
        rest = ["\u0100"] * token_counts.SHORT
        merged_rest = token_counts.count_merged(rest, vocabulary.ranks)
        if (symbols[-1], rest[0]) not in vocabulary.ranks:
            assert token_counts.count_merged(symbols + rest, vocabulary.ranks) <= short + merged_rest


def test_warc_round_trip(spark, tmp_path):
    crlf = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"
    rows = [(1, "http://a b/\n", crlf), (2, None, None), (3, "u", ""), (4, "u", crlf), (9, "http://q", "zzé"), (7, "http://z", "zzé"), (11, "v", "p" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.resolve(warc.read_warc(spark, warc.convert(warc.pages_to_arc(pages.repartition(3)))))
    got = {r.key: r for r in found.collect()}
    same = defaultdict(list)
    for key, _, html in rows:
        same[html or ""].append(key)
    assert len(got) == len(rows)
    for key, _, html in rows:
        payload, r = (html or "").encode(), got[key]
        first = max(same[html or ""])
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if key == first else ("revisit", first))
    assert warc.read_warc(spark, warc.convert(warc.pages_to_arc(pages.limit(0)))).count() == 0
    repeated = spark.createDataFrame([(None, "u", "a"), (5, "u", "a"), (5, "u", "a")], "page_id long, url string, html string")
    types = Counter((r.key, r.record_type, r.refers_to) for r in warc.resolve(warc.read_warc(spark, warc.convert(warc.pages_to_arc(repeated)))).collect())
    assert types == {(None, "revisit", 5): 1, (5, "response", None): 2}


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_header_lines(version):
    records = [("http://a/", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\n2 0 x"), ("dns:a", "text/dns", b"1.2.3.4"), ("b c", "text/plain", b"")]
    archive = warc.arc_archive("x.arc", version, "20240229", records)
    parsed = list(warc.parse_arc(archive))
    assert [(r.url, r.content) for r in parsed] == [("http://a/", records[0][2]), ("dns:a", b"1.2.3.4"), ("b%20c", b"")]
    assert parsed[0].payload == b"<p>\n\n2 0 x"
    assert parsed[0].date == "2024-02-29T00:00:00Z"
    assert [list(warc.parse_warc(warc.warc_record(r, warc.digest(r.payload), None) + b"\r\n\r\n"))[0][0]["WARC-Type"] for r in parsed] == ["response", "resource", "resource"]
    cut = list(warc.parse_arc(warc.arc_archive("x.arc", version, "2024", records[:2])[:-3]))
    assert [(r.content, r.truncated) for r in cut] == [(records[0][2], False), (b"1.2.3", True)]
    assert [r.content for r in warc.parse_arc(archive[:-5])] == [records[0][2], b"1.2.3.4"]
    with pytest.raises(ValueError, match="no length"):
        list(warc.parse_arc(b"no archive\n"))


def test_near_duplicates_match_brute_force(spark, odd, empty):
    rng = random.Random(3)
    texts = odd_texts()
    for g in range(6):
        base = words(100 + g, 150).split()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for table in (docs, odd):
        rows = as_dicts(table)
        for percent in (80, 85):
            want = Counter((r["doc_id"], n, c) for r, (n, c) in zip(rows, brute.near_components(rows, percent)[0], strict=True))
            found = near_dedup.near_duplicates(table, percent=percent).collect()
            assert Counter((r.id, r.n_shingles, r.component_id) for r in found) == want
            assert all(r.kept == (r.id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base, texts = words(7, 100).split(), []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    want = near_dedup.near_duplicates(docs).orderBy("id").collect()
    assert [r.component_id for r in want] == [c for _, c in brute.near_components(as_dicts(docs), 85)[0]]
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 7)
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 9)
    assert near_dedup.near_duplicates(docs).orderBy("id").collect() == want


def test_one_near_duplicate_stays(odd):
    rows = as_dicts(odd)
    _, roots = brute.near_components(rows, 85)
    kept = as_dicts(near_dedup.drop_near_duplicates(odd))
    groups = {r for r, row in zip(roots, rows, strict=True) if brute.shingles(row["text"])}
    blank = [r for r in rows if not brute.shingles(r["text"])]
    assert len(kept) == len(groups) + len(blank)
    assert list(kept[0]) == odd.columns


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200), (199, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {199: 199, 200: 199, 201: 199}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_signature_matches_follow_similarity():
    rng = np.random.default_rng(1)
    near = []
    for _ in range(40):
        own = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        near.append((np.sort(own[:920]), np.sort(own[80:])))
    a, b = near_dedup.signatures([x for x, _ in near]), near_dedup.signatures([y for _, y in near])
    assert abs((a == b).mean() - 840 / 1000) < 0.02
    assert (a == b).sum(1).min() >= near_dedup.least_matches(near_dedup.COORDINATES, 84)


def test_a_window_of_many_items_is_dealt_over_the_passes(spark, monkeypatch):
    passage = words(3, 10)
    docs = spark.createDataFrame([(1, "so " + passage + " so"), (2, "clean"), (3, passage + " " + passage)], "doc_id long, text string")
    rows = [(f"i{n:03}", passage) for n in range(300)] + [(None, passage), (None, words(9, 12))]
    benchmark = spark.createDataFrame(rows, "item_id string, text string")
    sent, phrases = [], decontamination._phrases
    monkeypatch.setattr(decontamination, "_phrases", lambda found: sent.append(phrases(found)) or sent[-1])
    whole = decontamination.find_spans(docs, benchmark).orderBy("id").collect()
    assert [r.n_hit for r in whole] == [10, 0, 20] and whole[0]["items"] == [f"i{n:03}" for n in range(300)]
    # The passage stands once among the windows sent, whatever the number of its items.
    assert len(sent) == 1 and len(sent[0][0]) == 4
    assert decontamination.find_spans(docs, benchmark, windows_per_pass=60).orderBy("id").collect() == whole
    assert len(sent) == 7 and max(len(p[3]) for p in sent[1:]) < 100


def test_decontamination_matches_brute_force(spark, odd, empty):
    passage, short = words(50, 25), "Just FOUR little words"
    items = [(1, passage), (2, short), (None, words(51, 12)), (3, None), (4, "!!"), (10, passage[10:] + " x y"), (10, words(52, 3))]
    benchmark = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, spans string")
    texts = [f"before, {passage.upper()}! after", f"{short} {short}", short.replace(" ", " - "), words(51, 12), passage + " " + passage, "x", None, "", passage, words(52, 3) + " end"]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(odd)
    by_text = {r["text"]: brute.contamination(r["text"], [(str(i), t) for i, t in items if i is not None]) for r in as_dicts(docs)}
    all_hits = {r["text"]: brute.contamination(r["text"], items)[1] for r in as_dicts(docs)}
    want = Counter((r["doc_id"], len(by_text[r["text"]][0]), sum(all_hits[r["text"]]), ",".join(sorted(by_text[r["text"]][2]))) for r in as_dicts(docs))
    for limit in (decontamination.WINDOWS_PER_PASS, 9):
        found = decontamination.find_spans(docs, benchmark, windows_per_pass=limit)
        assert Counter((r.id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect()) == want
    own = spark.createDataFrame(rows_of(texts), SCHEMA)
    cleaned = {r.doc_id: r for r in decontamination.decontaminate(own, benchmark).collect()}
    assert set(cleaned) == {0, 5, 6, 7, 9}
    assert cleaned[0].text == "before, ! after"
    assert cleaned[0].n_chars == len("before, ! after")
    assert cleaned[9].text == " end"
    assert decontamination.decontaminate(docs, benchmark).columns == docs.columns
    assert decontamination.find_spans(empty, benchmark).count() == 0
    assert decontamination.find_spans(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(0, 30, rng.integers(1, 6))
        text, bounds = rng.integers(1, rng.integers(2, 9), lengths.sum()).astype(np.uint64), np.r_[0, np.cumsum(lengths)]
        index = decontamination.FMIndex(text, bounds)
        phrases, sizes = rng.integers(1, 9, (20, 4)).astype(np.uint64), rng.integers(1, 5, 20)
        for phrase, n, low, high in zip(phrases, sizes, *index.search(phrases, sizes), strict=True):
            want = [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - n + 1) if (text[i : i + n] == phrase[:n]).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_exact_copies_match_brute_force(odd, empty):
    rows = as_dicts(odd)
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    want = Counter()
    for r in rows:
        same = groups[r["text"] or ""]
        keep = max((x for x in same if x is not None), default=None)
        want[(r["doc_id"], keep, len(same), r["doc_id"] == keep, hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    found = exact_dedup.copy_groups(odd, carry={"full": exact_dedup.full_hash()})
    assert Counter((r.id, r.keep_id, r.group_size, r.kept, r.full) for r in found.collect()) == want
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.copy_groups(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_copies_that_differ_after_the_prefix(spark):
    head = "h" * 100
    docs = spark.createDataFrame(rows_of([head + "a", head + "b", head + "a", head + "ab"]), SCHEMA)
    assert {r.id: (r.keep_id, r.group_size) for r in exact_dedup.copy_groups(docs).collect()} == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1)}


def test_url_rules(spark):
    urls = [None, "", "x", "http://a.ORG", "http://a.org/", "https://Example.org/es/1?q#f", "http://www.example.org/es", "http://example.org/en/12", "http://notexample.org/es/", "http://u.com/fr/1", "http://com/de/", "http://xcom/de/", "ftp://a.com?x/de/", "http://a.com/de/x://y", "http://example.org.com/de/", "http://é.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[5]])], "page_id long, url string, host string")
    rules = [url_filter.host_path_rule(*r) for r in url_filter.CONTRACT_RULES]
    found = sorted(url_filter.judge_urls(pages, rules).collect())
    for r, u in zip(found, [*urls, urls[5]], strict=True):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = __import__("re").match(r"[^/?#]*", rest)[0]
        path = __import__("re").match(r"[^?#]*", rest[len(host) :])[0]
        host = brute.lower(host)
        fit = [(len(x), v, x) for v, x in url_filter.CONTRACT_RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else "allow")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.rule for r in url_filter.judge_urls(pages, []).collect()} == {None}
    index = url_filter.RuleIndex(rules, {"org": 9, "com": 9, "example": 2, "es": 1, "fr": 3, "de": 4, "en": 5})
    assert sorted(index.posted) == ["com", "de", "es", "example", "fr", "org"] or sorted(index.posted) == ["de", "es", "example", "fr", "org"]


def test_mix_follows_targets_and_budgets(spark, odd, empty):
    for docs in (odd, queries.read(spark, SMALL, "documents")):
        rows = as_dicts(docs)
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(brute.WHITE.findall(r["text"] or ""))
        want = brute.targets(sizes)
        labels = spark.createDataFrame([(6, 1), (6, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
        mixed = mixing.mix(mixing.document_sizes(docs, labels))
        found = mixed.collect()
        assert len(found) == len(rows)
        taken, largest = Counter(), Counter()
        for r in found:
            assert r.source_size == sizes[r.source]
            assert r.target == pytest.approx(want[r.source])
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
        again = mixing.mix(mixing.document_sizes(docs.repartition(5), labels))
        assert Counter((r.id, r.hash, r.taken) for r in again.collect()) == Counter((r.id, r.hash, r.taken) for r in found)
        distinct = docs.dropDuplicates(["doc_id", "text"])
        plain = distinct.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "source", mixing.word_count(F.col("text")).alias("size"), mixing.exponential_key(F.col("doc_id"), mixing.text_weight(F.col("text"))).alias("key"))
        drawn = Counter((r.id, r.hash, r.copies) for r in mixing.mix(plain).collect() if r.copies)
        kept = mixing.mixed_documents(distinct)
        assert Counter(tuple(r) for r in kept.select("doc_id", F.xxhash64("text"), "copies").collect()) == drawn
        assert set(kept.columns) == {*docs.columns, "copies"}
        repeated = mixing.mixed_documents(docs).groupBy("doc_id", "text").agg(F.countDistinct("copies").alias("kinds"))
        assert repeated.where("kinds > 1").isEmpty()
    assert mixing.mix(mixing.document_sizes(empty, None)).count() == mixing.mixed_documents(empty).count() == 0


def test_mix_does_not_depend_on_ranges(spark, monkeypatch):
    docs = queries.read(spark, SMALL, "documents")
    want = Counter(tuple(r) for r in mixing.mix(mixing.document_sizes(docs, None)).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 2)
    assert Counter(tuple(r) for r in mixing.mix(mixing.document_sizes(docs, None)).collect()) == want


def test_pseudo_likelihood_by_hand(spark, odd, empty):
    model = language_model.fit_language_model(odd, rounds=1)
    text = "a1 b2 c3 a1"
    found = language_model.score_documents(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, n_words string"), model)
    got = {r.id: r for r in found.collect()}
    from ebbline.llm.text_arrays import SPACED, hashed_words

    network, counts = model.network, {r.word: r.n for r in model.counts.collect()}
    hashes = [h for _, _, hs, _ in hashed_words(pa.array([text]), SPACED) for h in hs]
    ids = [int(h >> np.uint64(64 - language_model.VOCABULARY_BITS)) for h in hashes]
    total = 0.0
    for i, w in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else language_model.OUTSIDE for j in (i - 2, i - 1, i + 1, i + 2)]
        hidden = np.tanh(np.concatenate([network.words[a] for a in around]) @ network.context + network.context_bias)
        logits = hidden @ network.out + network.out_bias
        share = np.log(counts.get(int(hashes[i].view(np.int64)), 1)) - network.log_class[network.classes[w]]
        total += logits[network.classes[w]] - np.log(np.exp(logits).sum()) + share
    assert got[1].log_likelihood == pytest.approx(total, rel=1e-4)
    assert got[1].mean_log_probability == pytest.approx(total / 4, rel=1e-4)
    assert (got[2].n_words, got[2].log_likelihood, got[2].mean_log_probability) == (0, 0.0, None)
    # The counts are exact; shares of the words and the unit of each class make a distribution.
    spaced = [w for r in odd.collect() for w in re.findall("[^\x20\x09-\x0D]+", r.text or "")]
    exact = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in spaced)
    assert sorted(counts.values()) == sorted(exact.values())
    held = Counter()
    for word, n in counts.items():
        held[int(network.classes[np.int64(word).view(np.uint64) >> np.uint64(64 - language_model.VOCABULARY_BITS)])] += n
    assert [np.log(held[c] + 1) for c in range(language_model.CLASSES)] == pytest.approx(network.log_class)
    assert language_model.score_documents(empty, language_model.fit_language_model(empty)).count() == 0


def test_rare_words_are_joined_with_their_counts(spark):
    # Words too rare to travel with the network; copies and repeated rows score alike.
    common = words(3, 4 * language_model.FREQUENT, 30)
    texts = [common, "once twice twice", "thrice " * 3, "once more", "once more", common]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language_model.fit_language_model(docs, rounds=0)
    counts = {r.word: r.n for r in model.counts.collect()}
    assert len(model.network.frequent) < len(counts)
    got = {r.id: r.log_likelihood for r in language_model.score_documents(docs, model).collect()}
    everything = language_model.Model(**{**vars(model.network), "frequent": np.array(sorted(counts)), "times": np.array([counts[w] for w in sorted(counts)])})
    whole = language_model.score_documents(docs, language_model.LanguageModel(everything, model.counts.limit(0)))
    assert got == pytest.approx({r.id: r.log_likelihood for r in whole.collect()})
    assert len(got) == 6 and got[3] == got[4] and got[0] == got[5]


def test_training_raises_the_likelihood(spark):
    docs = queries.read(spark, "/root/testdata/sf0.01", "documents")
    means = []
    for rounds in (0, 2):
        model = language_model.fit_language_model(docs, rounds=rounds)
        means.append(language_model.score_documents(docs, model).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0])
    assert means[1] > means[0] + 0.05


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in queries.read(spark, folder, "labels").collect()}
    found = queries.op10_quality_classifier(spark, folder).collect()
    assert len(found) == 1000
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (12, 0), (14, 0), (None, 1), (3, None)], "doc_id long, quality int")
    network = quality.fit_quality(odd, labels)
    scored = quality.score_quality(odd, network).collect()
    by_text = defaultdict(set)
    for r in scored:
        by_text[r.text or ""].add(r.quality_score)
    assert len(scored) == odd.count()
    assert all(len(x) == 1 and 0 <= min(x) <= 1 for x in by_text.values())
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert {r.quality_score for r in quality.score_quality(odd, quality.fit_quality(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score_quality(empty, network).count() == 0


def test_quality_without_labels_of_these_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(i, 30)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    for nothing in (labels.limit(0), labels.where("doc_id > 100")):
        assert quality.keep_good(docs, nothing).count() == 40
    # Labels of other ids take no place in the sample.
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 5)
    sample = quality.labelled_sample(docs, labels, "doc_id", "text")
    assert Counter(sample["label"].to_pylist()) == {0.0: 5, 1.0: 5}


def test_scores_do_not_depend_on_neighbours():
    texts = [words(i, 20 + 37 * i) for i in range(12)] + ["", "a"]
    network = quality.Network()
    network.weights["out"] = np.linspace(-1, 1, 2 * quality.HIDDEN).astype(np.float32)
    alone = [quality.score(network, pa.array([t]))[0] for t in texts]
    assert quality.score(network, pa.array(texts)) == pytest.approx(alone, abs=1e-5)


def test_equal_texts_score_alike_in_any_company():
    network = quality.Network()
    network.weights["out"] = np.linspace(-1, 1, 2 * quality.HIDDEN).astype(np.float32)
    texts = [words(i, 5 + 61 * i) for i in range(9)] + [""]
    alone = {t: quality.score(network, pa.array([t]))[0] for t in texts}
    for turn in range(len(texts)):
        row = texts[turn:] + texts[: turn // 2]
        assert quality.score(network, pa.array(row)).tolist() == [alone[t] for t in row]


def test_ranges_of_a_text_give_the_same_network(monkeypatch):
    network = quality.Network()
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    network.weights["out"] = np.linspace(-1, 1, 2 * quality.HIDDEN)
    data, offsets = quality.utf8(pa.array([words(1, 900), "", words(2, 400), "De De De De De " * 60, words(3, 40)]))
    stream, first = quality.layout(data, offsets)
    error = np.linspace(-1, 1, 5)
    logits, state = network.forward(stream, first)
    whole = network.gradients(state, error)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(quality, "RANGE_UNITS", size)
        again, state = network.forward(stream, first)
        assert again == pytest.approx(logits, abs=1e-9)
        for name, grad in network.gradients(state, error).items():
            assert grad == pytest.approx(whole[name], abs=1e-9), name


def test_whole_texts_are_fitted(spark):
    long_text = words(1, 20_000)
    docs = spark.createDataFrame([(i, long_text + f" w{i}") for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, "doc_id", "text", rows_per_class=1)
    assert len(sample) == 2 and all(t.startswith(long_text) for t in sample["text"].to_pylist())


def test_quality_gradients():
    network, rng = quality.Network(), np.random.default_rng(0)
    network.weights = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in network.weights.items()}
    data, offsets = quality.utf8(pa.array([words(1, 300), words(2, 20), "De De De De", ""]))
    stream, first = quality.layout(data, offsets)
    labels = np.array([0, 1, 0, 1.0])

    def loss():
        logits = network.forward(stream, first)[0]
        return (np.logaddexp(0, logits) - labels * logits).sum()

    logits, state = network.forward(stream, first)
    for name, grad in network.gradients(state, 1 / (1 + np.exp(-logits)) - labels).items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in grad.shape) if name != "bytes" else (rng.integers(97, 106), rng.integers(0, 7))
            value = network.weights[name][at]
            network.weights[name][at] = value + 1e-5
            up = loss()
            network.weights[name][at] = value - 1e-5
            down = loss()
            network.weights[name][at] = value
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=2e-3, rel=2e-2)

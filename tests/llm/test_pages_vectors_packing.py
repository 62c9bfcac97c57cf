"""Operators on pages and vectors, packing and the pipeline against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from check import normalised
from factorspark.llm import classify, html_extract, packing, url_filter

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

URLS = [
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/1?x=/fr/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com", "com", "", None, "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("http://a.net/es/x#y", "a.net", "/es/x", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, "allow"),
    ("http://net/fr/?", "net", "/fr/", "net/fr/", "block"),
    ("http://a.com?b=/c/://d", "a.com", "", None, "allow"),
    ("no scheme.com/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://\u00c9.com/", "\u00c9.com", "/", "com/", "allow"),
]


def test_rules_of_urls(spark):
    rows = [(i, u, "h", "v", 1) for i, (u, *_) in enumerate(URLS)] + [(None, "http://a.com/", "h", "v", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, number int")
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_filter.judge(pages, min_support=0.2).collect()}
    assert got.pop(None) == ("a.com", "/", "com/", "allow")
    assert got == {i: tuple(u[1:]) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_mined_rules_equal_counting(spark):
    """Support and confidence by brute force over all token sets; matches by the sets themselves."""
    rng = np.random.default_rng(4)
    words = list("abcdef")
    rows = []
    for i in range(400):
        tokens = sorted(rng.choice(words, rng.integers(1, 5), replace=False).tolist())
        rows.append((i, "http://h.org/" + "/".join(tokens), bool({"a", "b"} <= set(tokens) and rng.random() < 0.95)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "id long, blocked boolean")
    sets = [({f"path:{w}" for w in r[1].split("/")[3:]} | {"scheme:http", "host:h", "host:org"}, r[2]) for r in rows]
    items = sorted(set().union(*(s for s, _ in sets)))
    wanted = {}
    for mask in range(1, 1 << len(items)):
        chosen = {items[i] for i in range(len(items)) if mask >> i & 1}
        hold = [blocked for s, blocked in sets if chosen <= s]
        if hold and sum(hold) >= 0.05 * len(rows) and sum(hold) / len(hold) >= 0.8:
            wanted[tuple(sorted(chosen))] = sum(hold) / len(hold)
    frame = pages.join(labels, F.col("page_id") == F.col("id")).select(
        url_filter.url_tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"), "blocked")
    got = {tuple(r["tokens"]): r["confidence"] for r in url_filter.mined_rules(frame, 0.05, 0.8).collect()}
    # The rules without a rule inside them; scheme and host, which all rows share, count as one item.
    item = {"scheme:http": "host:h", "host:org": "host:h"}
    smallest = {tuple(sorted({item.get(t, t) for t in w})): c for w, c in wanted.items() if not any(set(v) < set(w) for v in wanted)}
    assert got == pytest.approx(smallest) and wanted
    judged = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labels=labels, min_support=0.05).collect()}
    assert judged == {i: "block" if any(set(w) <= s for w in wanted) else "allow" for i, (s, _) in enumerate(sets)}


def plain_verdicts(sets, least, confidence):
    """Verdicts by all token sets that some labelled row holds."""
    rules = []
    for tokens, blocked in sets:
        names = sorted(tokens)
        for mask in range(1, 1 << len(names)) if blocked else ():
            chosen = {names[i] for i in range(len(names)) if mask >> i & 1}
            hold = [b for s, b in sets if chosen <= s]
            if sum(hold) >= least and sum(hold) / len(hold) >= confidence:
                rules.append(chosen)
    return ["block" if any(r <= s for r in rules) else "allow" for s, _ in sets]


def test_long_urls_in_small_tables(spark):
    """Two urls of the same sixty words among twenty; verdicts as with a short url of the same kind."""
    words = ["".join(chr(97 + (i // 26**j) % 26) for j in range(3)) for i in range(60)]
    short = [f"http://h.org/{w}/{'x' if i % 2 else 'y'}" for i, w in enumerate("abcdefghijklmnopqr")]
    urls = [f"http://h.org/{'/'.join(words)}", f"http://h.org/{'/'.join(words)}/x", *short]
    blocked = [True, True, *(i % 3 == 0 for i in range(18))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(enumerate(blocked)), "id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules=(), labels=labels).collect()}
    sets = [({"http", "h", "org", *u.removeprefix("http://h.org/").replace("/".join(words), "word").split("/")}, b) for u, b in zip(urls, blocked)]
    assert got == dict(enumerate(plain_verdicts(sets, 2, 0.8)))
    assert got[0] == got[1] == "block"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<header><p>Site header with rather a lot of words in it, more than any line of text.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies for a great many things that nobody reads about at all.</div>
<div class="ad">Buy this and that and everything else we have in store for you today</div>
{body}
<aside><p>Related: a long list of other things that could be read instead of this one.</p></aside>
<form><label>Name</label><input name="n"><button>Send</button></form>
<div id="comments"><div class="comment"><p>A reader says that this is all wrong, and at great length too.</p></div></div>
<footer>&copy; Somebody 2020 and all the usual words of a footer go here</footer></body></html>"""
TEXT = "A title &amp; more\nFirst   paragraph with <b>bold</b> words&nbsp;and a <a href='x'>link</a>, long enough to count."


@pytest.mark.parametrize("body, wanted", [
    ("<article><h1>Head &amp; toe</h1><p>A <b>bold</b>\n  word&nbsp;&lt;x&gt;.</p><p>B.</p><!-- no --><p></p><p>C<br>D &eacute;&#8364;</article>",
     "Head & toe\nA bold word <x>.\nB.\nC D \u00e9\u20ac"),
    ("<article><p>Only.</p><aside>Not this</aside><ul><li>i</li><li>j</li></ul></article>", "Only.\ni\nj"),
    ("<div><h1>Plain page without an article element</h1><p>It has a first paragraph of some length.</p><p>Short.</p></div>",
     "Plain page without an article element\nIt has a first paragraph of some length.\nShort."),
    ("<main><p>a &lt b &am c</p></main>", "a < b &am c"),
    ("<article class='post'><header class='post-header'><h1>Kept</h1></header><div class='share-bar'>Share</div><p>Text.</p>"
     "<div class='notice'>Note</div><section id='comments'><article class='comment'><p>No.</p></article></section></article>", "Kept\nText."),
    ("<div class='ad'>Never closed <article><p>Kept.</p></article>", "Kept."),
    ("<article><table><tr><td>a<td>b</table><dl><dt>c<dd>d</dl><p hidden>x</p></article>", "a\nb\nc\nd"),
    ("<article></article>", ""),
    ("", ""),
])
def test_pages_give_their_article(body, wanted):
    assert html_extract.main_text(PAGE.replace("{body}", body)) == wanted


LONG = "A long main text that stands in a plain element of the page and goes on for quite a while. " * 4


def test_lengths_and_links_decide_on_marked_pages():
    """A teaser in an article does not hide the text; links in an article and few words beside it weigh little."""
    page = f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Teaser.</p><p><a href='x'>Read more</a></p></article>"
    assert html_extract.main_text(PAGE.replace("{body}", page)) == f"{LONG.strip()}\n{LONG.strip()}"
    links = "".join(f"<li><a href='/{i}'>Another story of the day, number {i}</a></li>" for i in range(5))
    page = f"<main><h1>Hi</h1><p>{LONG}</p><p>B.</p><ul>{links}</ul></main>"
    assert html_extract.main_text(PAGE.replace("{body}", page)) == f"Hi\n{LONG.strip()}\nB."
    page = f"<div>Some words above the article, of no great length</div><article><p>{LONG}</p><p>C.</p></article><div>And below</div>"
    assert html_extract.main_text(PAGE.replace("{body}", page)) == f"{LONG.strip()}\nC."


LONG = "A paragraph that is long enough to be the text of a page, with many words in it and an end."


@pytest.mark.parametrize("body, wanted", [
    # no element says which lines are the text
    (f"<div class='top'>Site name and slogan</div><div><p>{LONG}</p><p>{LONG}</p></div><div class='bottom'><p>Copyright Somebody 2020</p><p>All rights</p></div>",
     [LONG, LONG]),
    (f"<div>Home</div><div>About us</div><h1>The title</h1><div>{LONG}</div><div>Short.</div><div>{LONG}</div><div>Top</div>", ["The title", LONG, "Short.", LONG]),
    # an article that is a mere card does not outweigh the long text outside
    (f"<article><p>A card.</p></article><div>{LONG}</div><div>{LONG}</div>", [LONG, LONG]),
    ("<div>one</div><div>two lines</div>", ["two lines"]),
    ("<div><a href='x'>all links</a></div>", []),
    # a gap of more lines than the window ends the text
    (f"<div>{LONG}</div>" + "<div>x</div>" * 5 + f"<div>{LONG}</div>", [LONG, LONG]),
])
def test_lengths_find_the_text_without_marks(body, wanted):
    assert html_extract.main_text(f"<html><body>{body}</body></html>").split("\n") == (wanted or [""])


def test_extraction_of_a_table(spark):
    rows = [(1, "u", None, 1, "x"), (2, None, "", 1, "x"), (None, "u", "<p>loose text that has no end", 1, "x"), (3, "u", "<", 1, "x"),
            (4, "u", "<script>never closed <p>x", 1, "x"), (4, "u", "<article><p>" + "word " * 50_000, 1, "x"), (5, "u", "<a <b x='>'", 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = [(r["page_id"], r["text"]) for r in got]
    assert (1, "") in texts and (2, "") in texts and (None, "loose text that has no end") in texts and (4, "") in texts
    assert (4, ("word " * 50_000).strip()) in texts
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_given_pages_lose_no_paragraph(spark):
    import html
    import re

    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert html_extract.main_text(row["html"]) == "\n".join(x for x in lines if x)


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "a", "The", "'s", "don't", "\u00e9", "\u4e2d", "\U0001F511", "12", "...", "\u00a0", "<|endoftext|>", "\x1c", "\u2028"])


@given(st.lists(PARTS, max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


ENCODER, TOKENIZER = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
TOKENIZER.encode_special_tokens = True


@pytest.mark.parametrize("run", [" ", "\n", " \n\t", "\u2003 "])
def test_long_runs_of_white_space(run):
    for text in (run * (2_000_000 // len(run)), "a" + run * (2_000_000 // len(run)) + "b c", "x y" + run * 9_000 + "z"):
        assert np.frombuffer(ADDED_ENCODER.encode(text), "<u4").tolist() == DEFAULT_TOKENIZER.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([" " * 9_999, "\n" * 10_000, " a", "<|endoftext|>", "\t", "b", "\u00a0" * 12_000]), max_size=6).map("".join))
@settings(max_examples=25, deadline=None)
def test_ids_around_long_runs(text):
    assert np.frombuffer(ADDED_ENCODER.encode(text), "<u4").tolist() == DEFAULT_TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_most_sequences_come_from_the_program():
    rng = np.random.default_rng(5)
    demand = np.bincount(np.minimum(2048, rng.lognormal(5.5, 1.2, 150_000).astype(int) + 1), minlength=2049)[1:]
    used, left, bound = packing.configurations(demand)
    program = sum(amount for lengths, amount in used if lengths != [2048])
    whole = sum(amount for _, amount in packing.solve(demand))
    assert program >= 0.9 * (whole - demand[2047]) and whole <= 1.01 * max(bound, packing.lower_bound(demand))


def check_packing(docs, rows, capacity):
    """Round trip of ids, cuts and places."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = Counter()
    for doc in docs:
        ids = np.array([*TOKENIZER.encode(doc["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, (start, length) in enumerate(packing.cuts(len(ids), capacity)):
            wanted[doc["doc_id"], piece, start, length, zlib.crc32(ids[start: start + length].tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == wanted
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), math.ceil(sum(r["length"] for r in rows) / capacity)


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check_packing(docs.collect(), packing.pack(docs, VOCABULARY).collect(), 2048)
    assert used <= 1.02 * least + 1


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "word " * 200, "x"), (2, "word " * 200, "x"), (3, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check_packing(docs.collect(), packing.pack(docs, VOCABULARY, capacity=16).collect(), 16)
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    assert packing.cuts(16, 16) == [(0, 16)] and packing.cuts(33, 16) == [(0, 1), (1, 16), (17, 16)] and packing.cuts(32, 16) == [(0, 16), (16, 16)]


ADDED_ENCODER, DEFAULT_TOKENIZER = packing.Encoder(VOCABULARY, added=True), Tokenizer.from_file(VOCABULARY)


@given(st.lists(PARTS | st.just("<|endoftext|>"), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_default_tokenizer(text):
    assert np.frombuffer(ADDED_ENCODER.encode(text), "<u4").tolist() == DEFAULT_TOKENIZER.encode(text, add_special_tokens=False).ids


def test_packing_takes_added_tokens_as_the_library_does(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y <|endoftext|", "a  <|endoftext|>  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs, VOCABULARY).collect()}
    ids = [np.array([*DEFAULT_TOKENIZER.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert ids[0].tolist() == [64, 220, 50256, 275, 0]
    assert rows == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


@given(st.lists(st.integers(0, 500), min_size=24, max_size=24))
@settings(max_examples=40, deadline=None)
def test_solution_covers_the_histogram_exactly(demand):
    demand = np.array(demand)
    solution = packing.solve(demand, 24)
    assert packing.lower_bound(demand, 24) <= sum(amount for _, amount in solution)
    covered = np.zeros(24, int)
    for lengths, amount in solution:
        assert amount > 0 and sum(lengths) <= 24
        for length in lengths:
            covered[length - 1] += amount
    assert (covered == demand).all()


@pytest.mark.parametrize("key", ["op1_secret_scan", "op10_maxscore_topk", "op12_centroid_clusters", "op13_hard_negatives"])
def test_statements(spark, key):
    connection = duckdb.connect()
    for name in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    theirs = connection.execute(entry_points.oracle_sql()[key]).fetchdf()
    mine = entry_points.queries()[key](spark, FOLDER).toPandas()
    assert sorted(mine.columns) == sorted(theirs.columns) and normalised(mine) == normalised(theirs)


def test_pipeline_equals_its_parts_by_hand(spark):
    """Language, near copies, masks and copies redone row by row, then a packing round trip."""
    from test_text_operators import linked, plain_fingerprint

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    accepted = {r["doc_id"] for r in classify.identify(docs, classify.language_model(docs)).where("accepted").collect()}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] in accepted]
    labels = linked(np.array([plain_fingerprint(r["text"]) for r in rows], np.uint64), [r["doc_id"] for r in rows])
    kept = {r["doc_id"]: r for r, label in zip(rows, labels) if r["doc_id"] == label}
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        staged = stage(spark, staged, FOLDER)
    assert staged.columns == docs.columns and {r["doc_id"] for r in staged.collect()} == set(kept)
    masked = corpus_pipeline.secrets(spark, staged, FOLDER)
    for row in masked.collect():
        assert row["text"].split("[SECRET]")[0] == kept[row["doc_id"]]["text"][: len(row["text"].split("[SECRET]")[0])]
    copies = corpus_pipeline.mix(spark, masked, FOLDER).collect()
    check_packing(copies, corpus_pipeline.run(spark, FOLDER).collect(), 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mix", "pack"]

"""Column functions against plain Python, on edge cases."""

import hashlib
import json
import math
import random
import re
import urllib.parse
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sheafline.functions import chunks as C
from sheafline.functions import html as H
from sheafline.functions import text as X
from sheafline.functions import urls as U
from sheafline.functions.compare import compare


def values(spark, items, column, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, {schema}")
    return [r[0] for r in df.coalesce(1).orderBy("i").select(column).collect()]


def squeeze(text):
    """What normalising means, in Python."""
    text = re.sub(r"[\r\n\t]+", " ", str(text).lower()) if text else ""
    return re.sub(r"\s{2,}", " ", text).strip()


TEXTS = [
    None, "", " ", "\t", "A\tB", "a\r\n\tb", "a \x0b b", "x y", "x  y", "\x1cé\x85",
    "ÀB  c\n", "　wide　", "one", "\x0b", "a\x0bb", "tab\t\ttab", "ŒUVRE  Straße",
]


def test_normalize_text(spark):
    assert values(spark, TEXTS, X.normalize_text("x")) == [squeeze(t) for t in TEXTS]


def test_normalize_falsy_values(spark):
    df = spark.createDataFrame([(0, False), (7, True), (None, None)], "n int, b boolean")
    for c in ("n", "b"):
        df = X.normalize_column(df, c)
    assert [tuple(r) for r in df.collect()] == [("", ""), ("7", "true"), ("", "")]


def test_words_match_python_split(spark):
    texts = [t or "" for t in TEXTS]
    assert values(spark, texts, X.words(F.col("x"))) == [t.split() for t in texts]


def test_prompt_render(spark):
    df = spark.createDataFrame([("r", 3, None)], "req string, n int, z string")
    template = "{{{req}}} n={n} z={z}"
    got = df.select(X.prompt_render(template, df.columns)).first()[0]
    assert got == template.format(req="r", n=3, z=None)
    assert df.select(X.prompt_render(None, df.columns)).first()[0] == "r"
    with pytest.raises(KeyError):
        X.prompt_render("{absent}", df.columns)


def test_content_hash(spark):
    df = spark.createDataFrame([("é", 1, None)], "b string, a int, c string")
    assert df.select(X.content_sha256("b")).first()[0] == hashlib.sha256("é".encode()).hexdigest()
    as_json = json.dumps(
        {"a": 1, "b": "é", "c": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":")
    )
    want = hashlib.sha256(as_json.encode()).hexdigest()
    assert df.select(X.content_sha256("b", "c", "a")).first()[0] == want


def test_json_repair(spark):
    got = values(
        spark, ["{'k': 1}", "no json"], X.parse_json(F.col("x"), "k int", repair=True)
    )
    assert got[0].k == 1 and (got[1] is None or got[1].k is None)


URLS = [
    "http://a.com", "HTTP://U:p@A.com:8080/x/y?q=1#f", "https://b.org/p;v=1?", "//c.net/z",
    "plain.com/x", "mailto:a@b", "http://h/a b|c", "ftp://d/..", "",
]


def test_url_parts(spark):
    def want(u):
        p = urllib.parse.urlsplit(u)
        return f"{p.scheme}://{p.netloc}", p.hostname or ""

    got = list(
        zip(
            values(spark, URLS, U.url_origin(F.col("x"))),
            values(spark, URLS, U.url_host(F.col("x"))),
        )
    )
    assert got == [want(u) for u in URLS]


def test_url_join(spark):
    base = "http://h.com:81/a/b/c.html?q=1#f"
    refs = ["", "d", "./d", "../d", "../../../d", "/r/./s/../t", "//o.org/x", "?z=2", "#g",
            "https://e.com/p", "d/..", "..", ".", "a/./b/../c?x=../y", "mailto:m@n", "/"]
    got = values(spark, refs, U.url_join(F.lit(base), F.col("x")))
    assert got == [urllib.parse.urljoin(base, r) for r in refs]
    assert values(spark, ["x/y", "?q"], U.url_join(F.lit("http://h.com"), F.col("x"))) == [
        "http://h.com/x/y",
        "http://h.com?q",
    ]


def test_percent_decode(spark):
    items = ["a%20b", "a+b", "100%", "%C3%A9", "plain"]
    assert values(spark, items, U.percent_decode(F.col("x"))) == [
        urllib.parse.unquote(i) for i in items
    ]


EDGE = """<html><head><title>T</title></head><body><nav>menu</nav>
<!-- <article>hidden</article> --><main class="m"><h1>One</h1><P>a <b>b</b>c<br/>d &amp;lt; &#233;&#x41;</p>
<aside>ad</aside><script>if (a < b) "</main>"</script><h2 id=x>Two</h2><ul><li>i<li>j</ul><h4>Four</h4>tail</main>
<footer>foot</footer></body></html>"""


def test_main_content_blocks_and_flat(spark):
    blocks, flat = (
        values(spark, [EDGE], H.main_content(F.col("x"), form))[0] for form in ("blocks", "flat")
    )
    assert blocks == "# One\na bc\nd &lt; éA\n## Two\nij\nFour\ntail"
    assert flat == "One a bc d &lt; éA Two ij Four tail"


def test_best_text_falls_back_to_the_page(spark):
    page = "<head><title>no</title></head><body><nav>n</nav><p>only &eacute;</p></body>"
    assert values(spark, [page, EDGE], H.page_text(F.col("x")))[0] == "n\nonly é"
    assert values(spark, [page], H.main_content(F.col("x"))) == [""]


def test_unclosed_and_repeated_containers(spark):
    pages = ["<article>a</article>x<article>b</article>", "<article>cut off", "<ARTICLE\n>u</ARTICLE >"]
    assert values(spark, pages, H.main_content(F.col("x"))) == ["a\nb", "cut off", "u"]


def test_long_page_has_no_stack_limit(spark):
    page = "<article><p>" + "word &amp; " * 300_000 + "<script>" + "x" * 500_000 + "</script></p></article>"
    assert len(values(spark, [page], H.main_content(F.col("x"), "flat"))[0]) == 7 * 300_000 - 1


def test_links_and_images(spark):
    page = "<a class='k' href='/x?a=1&amp;b=2'>x</a><A HREF=y.html>y</A><a name=z>z</a><img data-src='no' src=\"i.png\"><img alt=''><img src=''>"
    assert values(spark, [page], H.link_targets(F.col("x"))) == [["/x?a=1&b=2", "y.html"]]
    assert values(spark, [page], H.image_sources(F.col("x"))) == [["i.png"]]


def test_compare_all_operators(spark):
    df = spark.createDataFrame([(o,) for o in ("<=", "<", ">=", ">", "==")], "op string")
    got = df.select(compare(F.lit(1), F.col("op"), F.lit(1))).collect()
    assert [r[0] for r in got] == [True, False, True, False, True]
    bad = spark.createDataFrame([("!=",)], "op string")
    with pytest.raises(Exception, match="Unsupported op"):
        bad.select(compare(F.lit(1), F.col("op"), F.lit(1))).collect()


def sliding(words, text, window, step):
    if len(words) <= window:
        return [text]
    out = [words[i : i + window] for i in range(0, len(words) - window + 1, step)]
    if (len(words) - window) % step:
        out.append(words[-window:])
    return [" ".join(w) for w in out]


def overlapping(words, text, window, overlap):
    if len(words) <= window:
        return [text]
    out, start = [], 0
    while True:
        out.append(" ".join(words[start : start + window]))
        if start + window >= len(words):
            return out
        start += window - overlap


word_lists = st.lists(st.text("ab.é", min_size=1, max_size=3), max_size=40)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(word_lists, min_size=20, max_size=60))
def test_chunkers_match_python(spark, many):
    texts = [" ".join(w) for w in many]
    x = F.col("x")
    assert values(spark, texts, C.chunk_sliding(x, 5, 3)) == [
        sliding(t.split(), t, 5, 3) for t in texts
    ]
    assert values(spark, texts, C.chunk_overlap(x, 6, 2)) == [
        overlapping(t.split(), t, 6, 2) for t in texts
    ]
    fixed = values(spark, texts, C.chunk_fixed(x, 4))
    assert [" ".join(c).split() for c in fixed] == [t.split() for t in texts]
    assert all(len(p.split()) == 4 for c in fixed for p in c[:-1])
    assert values(spark, texts, C.chunk_token_window(x, 10, 0.25)) == [
        overlapping(t.split(), t, 10, 2) for t in texts
    ]


def test_chunk_regex_matches_python(spark):
    texts = ["Mr. A. met U.S. Army. Then? Yes!  End.", "no stop", "", "a.\nb. ", "Dr. No. ok"]
    assert values(spark, texts, C.chunk_regex(F.col("x"))) == [
        re.split(C.SENTENCE, t) for t in texts
    ]
    twice = [p for q in re.split(r"\n", texts[3]) for p in re.split(r" ", q)]
    assert values(spark, [texts[3]], C.chunk_regex(F.col("x"), [r"\n", " "])) == [twice]


def test_chunker_by_name():
    with pytest.raises(ValueError, match="no chunking strategy"):
        C.chunker("unheard")
    with pytest.raises(ValueError):
        C.chunk_overlap(None, 10, 10)


def topics(text, block=3):
    """The topic rule in plain Python."""
    sentences = re.split(C.SENTENCE, text)
    blocks = [
        Counter(" ".join(sentences[i : i + block]).lower().split())
        for i in range(0, len(sentences), block)
    ]
    gaps = []
    for i, (a, b) in enumerate(zip(blocks, blocks[1:])):
        if a and b:
            norm = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
            gaps.append((sum(n * b[w] for w, n in a.items()) / norm, i))
    starts = [0] + [
        (g[1] + 1) * block
        for before, g, after in zip(gaps, gaps[1:], gaps[2:])
        if g[0] < before[0] and g[0] < after[0]
    ]
    return [" ".join(sentences[s:e]) for s, e in zip(starts, [*starts[1:], len(sentences)])]


def test_topics_match_python(spark):
    rng = random.Random(2)
    vocabularies = ["cats purr mice mats softly".split(), "rockets burn fuel orbit engines".split()]
    texts = ["one.", "", "  ", "A. b. c. d."]
    for _ in range(60):
        sentences = []
        for _ in range(rng.randrange(1, 7)):
            own = rng.choice(vocabularies)
            for _ in range(rng.randrange(1, 9)):
                picked = [rng.choice(own) for _ in range(rng.randrange(1, 6))]
                sentences.append(" ".join(picked).capitalize() + ".")
        texts.append(" ".join(sentences))
    want = [topics(t) for t in texts]
    assert values(spark, texts, C.chunk_topics(F.col("x"))) == want
    assert max(len(w) for w in want) > 2
    assert values(spark, texts, C.chunker("topic_segmentation")(F.col("x"))) == want


PAGES = [
    # (page, text by hand)
    ("<article><p>one</p><nav-item>x</nav-item><p>two</p></article>", "one\nx\ntwo"),
    ("<main-menu>menu</main-menu><article>body</article>after", "body"),
    ("<article>a<article>comment</article>tail</article>end", "a\ncomment\ntail"),
    ("<article><p title='1 > 0'>kept</p><nav>no <nav>no</nav> no</nav> end</article>", "kept\nend"),
    ("<article>&#38;lt; and &lt; &ccaron; &Eacute; &amp;amp; &none; &#x41;</article>", "&lt; and < č É &amp; &none; A"),
    ("<p>nothing kept</p>", "nothing kept"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_content_by_depth(spark, page, text):
    from sheafline.functions import html as H

    row = spark.createDataFrame([(page,)], "html string").select(H.page_text(F.col("html")).alias("t"))
    assert row.first().t == text


def test_blanks_beyond_ascii_split_chunks(spark):
    from sheafline.functions import chunks as C

    df = spark.createDataFrame([("One. Two.　Three. Four.", "en")], "t string, l string")
    assert df.select(C.chunk_regex(F.col("t")).alias("c")).first().c == ["One.", "Two.", "Three.", "Four."]
    text = 'Mr. Hu said "Go!" Then etc. followed… End'
    df = spark.createDataFrame([(text, "en"), (text, "xx")], "t string, l string")
    got = [r.c for r in df.select(C.chunk_sentences(F.col("t"), F.col("l")).alias("c")).collect()]
    assert got[0] == ['Mr. Hu said "Go!"', "Then etc. followed…", "End"]
    assert got[1] == ["Mr.", 'Hu said "Go!"', "Then etc.", "followed…", "End"]


def test_row_hash_sorts_keys_at_every_depth(spark):
    schema = "b string, a struct<z: int, m: map<string, struct<y: int, x: string>>>, l array<struct<d: int, c: int>>"
    rows = [
        ("é", (1, {"k2": (1, "p"), "k1": (2, None)}), [(1, 2), None]),
        (None, None, []),
        ("x", (None, None), None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(X.row_sha256(df)).collect()]
    plain = [
        {"b": "é", "a": {"z": 1, "m": {"k2": {"y": 1, "x": "p"}, "k1": {"y": 2, "x": None}}}, "l": [{"d": 1, "c": 2}, None]},
        {"b": None, "a": None, "l": []},
        {"b": "x", "a": {"z": None, "m": None}, "l": None},
    ]
    dumped = [json.dumps(p, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for p in plain]
    assert got == [hashlib.sha256(d.encode()).hexdigest() for d in dumped]
    other = spark.createDataFrame(rows[:1], schema).select("l", "a", "b")
    assert other.select(X.row_sha256(other)).first()[0] == got[0]

"""Main content of malformed markup beside a stack of open elements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheafline.functions import html as H

TAG = re.compile(r"<(/?)([a-z0-9]+)[^>]*>")


def plain(page):
    """Words inside the outermost kept element and in no dropped element inside of it."""
    out, stack, at = [], [], 0
    for m in [*TAG.finditer(page), None]:
        words = page[at : m.start() if m else len(page)].split()
        first = next((i for i, x in enumerate(stack) if x in H.KEEP), None)
        if first is not None and not any(x in H.DROP for x in stack[first:]):
            out += words
        if m is None:
            break
        at, name = m.end(), m[2]
        if name not in (*H.KEEP, *H.DROP, *H.CONTAINERS):
            continue
        if not m[1]:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return out


def generated(seed):
    rnd = random.Random(seed)
    names = [*H.KEEP, *H.KEEP, *H.DROP, "div", "section", "ul", "p", "b"]
    parts = []
    for i in range(rnd.randrange(1, 60)):
        kind = rnd.random()
        name = rnd.choice(names)
        parts.append(f"w{i}" if kind < 0.3 else f"<{name} class='a>b'>".replace("a>b", "ab") if kind < 0.7 else f"</{name}>")
    return " ".join(parts)


def test_malformed_markup(spark):
    pages = [generated(i) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    got = {r.i: r.t for r in df.select("i", H.main_content(F.col("html"), "flat").alias("t")).collect()}
    bad = [(p, plain(p), got[i]) for i, p in enumerate(pages) if got[i].split() != plain(p)]
    assert not bad, bad[0]
    assert sum(bool(plain(p)) for p in pages) > 300


@pytest.mark.parametrize("page, text", [
    ("<article>a<nav>b</article>c", "a"),
    ("<article>a<aside>b</article></aside>c<main>d</main>", "a d"),
    ("<div><article>a</div>b", "a"),
    ("<article><div>a<form>b</div>c</article>d", "a c"),
    ("<nav><article>a</article></nav>b", "a"),
    ("</article>a<article>b</main>c", "b c"),
    ("<ARTICLE>a<Nav x='</nav>'>b</NAV> c", "a c"),
    ("<article>a<article>b</article>c", "a b c"),
    ("<articles>a</articles>", ""),
    ("", ""),
])
def test_mended(spark, page, text):
    row = spark.createDataFrame([(page,)], "html string").select(H.main_content(F.col("html"), "flat").alias("t"))
    assert row.first().t == text

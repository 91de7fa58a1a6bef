"""Main-content selection on stored HTML, with built-in expressions only.

The main content is found by a fold over tags with a stack of open elements (``_selected``), which
mends unclosed and crossing ones; other elements are matched by depth. A tag
name ends at a blank, a slash or the bracket, so ``nav-item`` is not ``nav``, and a quoted
attribute may hold ``>``. An element without an end reaches to the end of the page.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import let

KEEP = ("article", "main")
DROP = ("nav", "footer", "form", "aside")
#: Elements whose end also ends kept and dropped elements that were left open in them.
CONTAINERS = ("html", "body", "div", "section", "table", "ul", "ol")

# Every named reference that ends in a semicolon, from Python's own table.
ENTITIES = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}

# One leading '<' for all alternatives: most characters are passed over at once.
_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>"  # of a tag, behind its name
_END = r"(?=[\s/>])"  # a tag name ends here
_BREAKS = (
    rf"(?i)<(?:/?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre){_END}"
    rf"|/(?:h[1-6]|li|td|th){_END}|(?:br|hr|h[4-6]){_END}){_REST}"
)
_TAG = rf"<(?=[A-Za-z/!?]){_REST}"
_ATTRIBUTE = r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def _opened(tags: Sequence[str]) -> str:
    """An element of one of the tags, after its '<', up to the first end of its name: for
    elements whose content is not markup."""
    return rf"({'|'.join(tags)}){_END}{_REST}(.*?)(?:</\1\s*>|\z)"


def without_scripts(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    hidden = _opened(("script", "style", "noscript", "template"))
    return F.regexp_replace(html, rf"(?is)<(?:!--.*?(?:-->|\z)|{hidden})", "")


def _outside(markup: Column, tags: Sequence[str]) -> Column:
    """All that lies outside of elements of ``tags``.

    The pieces between these tags and the tags themselves are walked once. An end
    without a start counts for nothing. Any of the tags opens and closes a level.
    """
    pattern = rf"(?i)</?(?:{'|'.join(tags)}){_END}{_REST}"

    def walk(found: Column, pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array(F.get(pieces, F.lit(0))).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            depth = acc["depth"]
            ends = F.get(found, i).startswith("</")
            now = F.when(ends, F.greatest(depth - 1, F.lit(0))).otherwise(depth + 1)
            piece = F.array(F.get(pieces, i + 1))
            return F.struct(
                now.alias("depth"),
                F.when(now == 0, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
            )

        folded = F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"]
        )
        return F.when(F.size(found) > 0, F.array_join(folded, "")).otherwise(markup)

    found = F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))
    return let(found, lambda f: let(F.split(markup, pattern, -1), lambda pieces: walk(f, pieces)))


def unescape(text: Column) -> Column:
    """Character references to characters, each decoded once where it stands."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folds to a literal
    reference = r"&(?:[A-Za-z][A-Za-z0-9]*|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"

    def decode(ref: Column) -> Column:
        code = F.when(
            F.lower(ref).startswith("&#x"),
            F.conv(F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10),
        ).when(ref.startswith("&#"), F.regexp_extract(ref, r"^&#(\d+);$", 1))
        point = code.try_cast("bigint")
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.coalesce(F.when(valid, char), F.try_element_at(names, ref), ref)

    def whole(refs: Column) -> Column:
        pieces = F.split(text, reference, -1)
        parts = F.transform(
            pieces, lambda p, i: F.concat(p, F.coalesce(decode(F.get(refs, i)), F.lit("")))
        )
        return F.array_join(parts, "")

    decoded = let(F.regexp_extract_all(text, F.lit(reference), F.lit(0)), whole)
    return F.when(text.contains("&"), decoded).otherwise(text)


def _selected(clean: Column, keep: Sequence[str], drop: Sequence[str]) -> Column:
    """What lies inside the outermost ``keep`` elements, but not in a ``drop`` element inside of these.

    One fold over the tags of these and of ``CONTAINERS``, with the stack of open elements. An end tag
    closes the nearest open element of its name and all that were opened since, so elements left
    open end with what holds them, and crossing ones with the first end; without such an element it
    counts for nothing. Tags of kept elements stay as breaks, those of containers as they are.
    """
    names = [*keep, *drop, *(c for c in CONTAINERS if c not in (*keep, *drop))]
    pattern = rf"(?i)</?(?:{'|'.join(names)}){_END}{_REST}"

    def is_in(name: Column, names: Sequence[str]) -> Column:
        return name.isin(*names) if names else F.lit(False)

    def walk(found: Column, pieces: Column) -> Column:
        none = F.array().cast("array<string>")
        start = F.struct(
            none.alias("open"), F.lit(0).alias("kept"), F.lit(0).alias("dropped"), none.alias("out")
        )

        def step(acc: Column, i: Column) -> Column:
            tag = F.get(found, i)
            name = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z0-9]+)", 1))
            return let(name, lambda name: moved(acc, i, tag, name))

        def moved(acc: Column, i: Column, tag: Column, name: Column) -> Column:
            # levels count from 1; kept and dropped are those of the elements that began it, or 0
            depth = F.size(acc["open"])
            nearest = F.array_position(F.reverse(acc["open"]), name).cast("int")
            level = F.when(nearest > 0, depth - nearest + 1)
            closed = F.struct(
                F.slice(acc["open"], 1, level - 1).alias("open"),
                F.when(acc["kept"] >= level, 0).otherwise(acc["kept"]).alias("kept"),
                F.when(acc["dropped"] >= level, 0).otherwise(acc["dropped"]).alias("dropped"),
            )
            begins = is_in(name, keep) & (acc["kept"] == 0)
            hides = is_in(name, drop) & (acc["kept"] > 0) & (acc["dropped"] == 0)
            opened = F.struct(
                F.concat(acc["open"], F.array(name)).alias("open"),
                F.when(begins, depth + 1).otherwise(acc["kept"]).alias("kept"),
                F.when(hides, depth + 1).otherwise(acc["dropped"]).alias("dropped"),
            )
            same = F.struct(acc["open"].alias("open"), acc["kept"].alias("kept"), acc["dropped"].alias("dropped"))
            ends = tag.startswith("</")
            now = F.when(~ends, opened).when(level.isNotNull(), closed).otherwise(same)
            lead = F.when(is_in(name, keep), "<br>").when(is_in(name, drop), "").otherwise(tag)
            return let(now, lambda now: kept(acc, now, F.concat(lead, F.get(pieces, i + 1))))

        def kept(acc: Column, now: Column, piece: Column) -> Column:
            shown = (now["kept"] > 0) & (now["dropped"] == 0)
            out = F.when(shown, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
            return F.struct(
                now["open"].alias("open"), now["kept"].alias("kept"), now["dropped"].alias("dropped"), out.alias("out")
            )

        folded = F.aggregate(
            F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"]
        )
        return F.when(F.size(found) > 0, F.array_join(folded, "")).otherwise("")

    found = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
    return let(found, lambda f: let(F.split(clean, pattern, -1), lambda pieces: walk(f, pieces)))


def _mark_heading(markup: Column, level: int) -> Column:
    opening = rf"(?i)<h{level}{_END}{_REST}"
    marked = "\n" + "#" * level + " "
    return let(
        markup,
        lambda t: F.when(
            t.contains(f"<h{level}") | t.contains(f"<H{level}"),
            F.regexp_replace(t, opening, marked),
        ).otherwise(t),
    )


def _to_blocks(markup: Column) -> Column:
    text = F.regexp_replace(markup, r"[ \t\r\n\f]+", " ")
    for level in (1, 2, 3):
        text = _mark_heading(text, level)
    text = F.regexp_replace(text, _BREAKS, "\n")
    text = F.regexp_replace(text, _TAG, "")
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return unescape(F.btrim(text, F.lit(" \n")))


def _to_flat(markup: Column) -> Column:
    text = F.regexp_replace(markup, rf"{_BREAKS}|(?i:<h[1-3]{_END}{_REST})", " ")
    text = F.regexp_replace(text, _TAG, "")
    return unescape(F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " ")))


_RENDER = {}


def main_content(
    html: Column, form: str = "blocks", keep: Sequence[str] = KEEP, drop: Sequence[str] = DROP
) -> Column:
    """Text of the kept elements: a line per paragraph with ``#`` headings
    (``blocks``), or one line (``flat``). '' when nothing is kept."""
    return let(without_scripts(html), lambda clean: _main(clean, form, keep, drop))


def _main(
    clean: Column, form: str, keep: Sequence[str] = KEEP, drop: Sequence[str] = DROP
) -> Column:
    return _RENDER[form](_selected(clean, keep, drop))


def raw_content(html: Column, form: str = "blocks") -> Column:
    """Text of the whole page body, nothing but scripts and head removed."""
    return let(without_scripts(html), lambda clean: _raw(clean, form))


def _raw(clean: Column, form: str) -> Column:
    return _RENDER[form](_outside(clean, ("head",)))


_RENDER.update(blocks=_to_blocks, flat=_to_flat)


def best_text(fit: Column, raw: Column) -> Column:
    """The fitted text, or the raw text where the fitted one is empty."""
    return F.coalesce(F.nullif(fit, F.lit("")), raw)


def page_text(html: Column, form: str = "blocks") -> Column:
    """``best_text`` of a page, stripping the whole page only where needed."""
    return let(without_scripts(html), lambda clean: _text(clean, form))


def _text(clean: Column, form: str) -> Column:
    return let(
        _main(clean, form), lambda fit: F.when(fit != "", fit).otherwise(_raw(clean, form))
    )


def link_text(html: Column) -> Column:
    """Text inside the page's anchors, joined by single blanks."""
    return let(without_scripts(html), _links)


def _links(clean: Column) -> Column:
    inside = F.regexp_extract_all(
        clean, F.lit(rf"(?is)<a{_END}{_REST}(.*?)</a\s*>"), F.lit(1)
    )
    return _to_flat(F.array_join(inside, " "))


def page_parts(html: Column) -> Column:
    """{text, raw, links}: ``page_text``, the flat ``raw_content`` and ``link_text`` of a page,
    whose scripts are taken out once."""
    return let(
        without_scripts(html),
        lambda clean: F.struct(
            _text(clean, "blocks").alias("text"),
            _raw(clean, "flat").alias("raw"),
            _links(clean).alias("links"),
        ),
    )


def _values(html: Column, tag: str, attribute: str) -> Column:
    found = F.regexp_extract_all(
        without_scripts(html),
        F.lit(rf"(?is)<{tag}{_END}(?:[^>]*?\s)?{attribute}{_ATTRIBUTE}"),
        F.lit(1),
    )
    return F.transform(
        found, lambda v: unescape(F.trim(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    )


def link_targets(html: Column) -> Column:
    """``href`` of every anchor, in page order."""
    return _values(html, "a", "href")


def image_sources(html: Column) -> Column:
    """Non-empty ``src`` of every image, in page order."""
    return F.filter(_values(html, "img", "src"), lambda v: v != "")

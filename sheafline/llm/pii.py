"""Personal data by patterns, and by contexts that the patterns' finds induce.

Four kinds have a base pattern: email, ip, card and phone. Their finds are the seeds of
a bootstrapped search for identifiers that no pattern describes:

1. Each seed's neighbours give lexical patterns: the word before it, the word behind
   it. Candidates are tokens with several digits that no seed covers; they have
   the same kinds of neighbours.
2. Patterns and instances form a graph. A pattern's confidence is the share of
   known instances among all words that stand in its slot anywhere in the
   corpus; it must have ``MIN_SUPPORT`` different known ones. A candidate's score is one less the
   product of its patterns' doubts. Candidates of at least ``MIN_SCORE`` become known, and the
   patterns are scored again, until nothing is added.
3. Every occurrence of an accepted candidate is a span of kind ``other``.

Edges, totals and scores are Spark tables; nothing of them is collected. Base spans
always stay. Null and empty texts have no spans. Repeated rows are searched
each on its own. No documents give no rows. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import cut, keyed_texts, map_texts

KINDS = ("email", "ip", "card", "phone", "other")
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.6
ROUNDS = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits never starts a match in its middle, which the look-behind says outright
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_EDGES = ".,;:!?\"'()[]{}<>|"
_BLANKS = " \t\n\r\x0b\x0c"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each @ so that no text takes quadratic time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)  # no match reaches across this @
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _token(text: str, at: int, low: int) -> tuple[int, int]:
    """The blank-free stretch around ``at``, not before ``low``."""
    start = 1 + max(text.rfind(b, low, at) for b in _BLANKS)
    ends = [e for e in (text.find(b, at, at + 256) for b in _BLANKS) if e >= 0]
    if ends:
        return max(start, low), min(ends)
    m = re.compile(r"[^\x20\x09-\x0D]*").match(text, at)
    return max(start, low), m.end()


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like stretches outside of base spans: at least 6 characters, 3 of them digits."""
    out, done, k = [], 0, 0
    for m in _DIGITS.finditer(text):
        at = m.start()
        while k < len(base) and base[k][1] <= at:
            done = max(done, base[k][1])
            k += 1
        if at < done or (k < len(base) and base[k][0] <= at):
            continue
        start, end = _token(text, at, done)
        done = end
        if k < len(base):
            end = min(end, base[k][0])
        head = max(text.rfind("=", start, at), text.rfind(":", start, at))
        start = max(start, head + 1)
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if end - start >= 6 and sum(map(text[start:end].count, "0123456789")) >= 3:
            out.append((start, end))
    return out


def neighbour(word: str) -> str:
    """A word as it stands in a pattern."""
    return _DIGITS.sub("0", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a stretch: the word before, the word behind."""
    out = []
    before = text[max(0, start - 80) : start].rstrip(_EDGES.replace(":", "").replace("=", "") + _BLANKS)
    words = before.split()
    if words:
        out.append("before " + neighbour(words[-1]))
    words = text[end : end + 80].lstrip(_EDGES + _BLANKS).split()
    if words:
        out.append("behind " + neighbour(words[0].rstrip(_EDGES)))
    return out


def find(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, base spans, and mentions (seed or candidate) with patterns."""
    span = "array<struct<start:int,`end`:int,kind:string>>"
    mention = "array<struct<start:int,`end`:int,kind:string,instance:string,patterns:array<string>>>"

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"spans": [], "mentions": []}
        for text in texts:
            base = base_spans(text)
            named = [{"start": a, "end": b, "kind": k} for a, b, k in base]
            own = named + [
                {"start": a, "end": b, "kind": "other"} for a, b in candidates(text, base)
            ]
            out["spans"].append(named)
            out["mentions"].append(
                [
                    s | {"instance": text[s["start"] : s["end"]],
                         "patterns": patterns(text, s["start"], s["end"])}
                    for s in own
                ]
            )
        return out

    schema = f"row_key long, doc_id long, spans {span}, mentions {mention}"
    return map_texts(keyed_texts(docs), run, schema, ["row_key", "doc_id"])


def slot_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: how often each word stands in a text, as patterns write it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            folded: Counter = Counter()
            for w, n in counts.items():
                # a name joined to its value by = or : is a word of its own there
                head = w[: max(w.rfind("="), w.rfind(":")) + 1]
                for form in {neighbour(x) for x in (w.rstrip(_EDGES), w, head) if x}:
                    folded[form] += n
            return pa.RecordBatch.from_arrays(
                [pa.array(folded.keys(), pa.string()), pa.array(folded.values(), pa.int64())],
                names=["word", "n"],
            )

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(text.split())
                if len(counts) > 300_000:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    made = keyed_texts(docs).select("text").mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def bootstrap(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``instance``: the candidates that high-confidence patterns lead to."""
    mentions = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = cut(
        mentions.select("instance", (F.col("kind") != "other").alias("seed"), F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    )
    # only patterns with enough seeds or next to candidates can ever matter
    able = edges.groupBy("pattern").agg(
        F.sum((~F.col("seed")).cast("long")).alias("open"), F.count(F.lit(1)).alias("all")
    ).filter(f"open > 0 and all > {MIN_SUPPORT}").select("pattern")
    able = cut(able)
    if able.isEmpty():
        return edges.select("instance").limit(0)
    slots = F.split("pattern", " ", 2)
    totals = cut(
        able.withColumn("word", slots[1]).join(slot_counts(docs), "word").select("pattern", "n")
        .withColumnRenamed("n", "total")
    )
    edges = cut(edges.join(totals, "pattern"))
    known = cut(edges.filter("seed").select("instance").distinct())
    accepted = known.limit(0)
    for _ in range(ROUNDS):
        marked = edges.join(known.withColumn("known", F.lit(True)), "instance", "left")
        rated = marked.groupBy("pattern").agg(
            F.sum(F.col("known").isNotNull().cast("long")).alias("support"),
            (F.sum(F.when(F.col("known"), F.col("n"))) / F.max("total")).alias("confidence"),
        ).filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        new = cut(
            marked.filter("known is null").join(rated, "pattern").groupBy("instance")
            .agg((1 - F.exp(doubt)).alias("score")).filter(F.col("score") >= MIN_SCORE)
            .select("instance")
        )
        if new.isEmpty():
            break
        known, accepted = cut(known.unionByName(new)), cut(accepted.unionByName(new))
    return accepted


def _added(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """``row_key`` and the spans that accepted instances add."""
    own = found.select("row_key", F.explode("mentions").alias("m")).filter("m.kind = 'other'")
    own = own.select("row_key", F.col("m.instance").alias("instance"), F.struct("m.start", "m.end", "m.kind").alias("s"))
    return own.join(accepted, "instance").groupBy("row_key").agg(F.collect_list("s").alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """``row_key``, ``doc_id``, base ``spans`` and all ``found`` (base and added, by start)."""
    found = cut(find(docs))
    added = _added(found, bootstrap(docs, found))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.concat("spans", F.coalesce("added", F.array().cast(dict(found.dtypes)["spans"])))
    ordered = F.array_sort(
        F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return found.join(added, "row_key", "left").select(
        "row_key", "doc_id", "spans",
        F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"),
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``personal_data``."""
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return personal_data(docs).select(
        "doc_id",
        *(
            F.size(F.filter(F.col("spans.kind"), _is(kind))).cast("long").alias(f"n_{kind}")
            for kind in KINDS[:4]
        ),
        F.sha2(text(F.col("spans")), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each stretch of touching spans replaced by the kind of its first."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced; ``n_chars``, where there, follows the text."""
    found = cut(find(docs))
    added = cut(_added(found, bootstrap(docs, found)))

    def masked(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, extra in zip(texts, more):
            if text is None:
                out.append(None)
                continue
            spans = base_spans(text)
            if extra is not None and len(extra):
                spans = sorted(
                    [*spans, *((s["start"], s["end"], s["kind"]) for s in extra)],
                    key=lambda s: (s[0], KINDS.index(s[2])),
                )
            out.append(mask_text(text, spans) if spans else text)
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(masked, "string")
    span = "array<struct<start:int,`end`:int,kind:string>>"
    rows = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("row_key"))
    if added.isEmpty():  # then no text has to move
        rows = rows.withColumn("added", F.lit(None).cast(span))
    else:
        rows = rows.join(added, "row_key", "left")
    text = udf(F.col("row_.text").cast("string"), F.col("added"))
    rows = rows.select("row_", text.alias("masked_"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("masked_").alias("text"))
        elif name == "n_chars":
            length = F.length("masked_").cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(F.col("row_.n_chars").isNotNull(), length).alias("n_chars"))
        else:
            columns.append(F.col("row_").getField(name).alias(name))
    return rows.select(*columns)

"""Exact duplicates by composable polynomial fingerprints.

A text, its runs of ASCII blanks replaced by one space, is cut into chunks of
bytes. Each chunk has its polynomial hash modulo two primes and the power of the
base for its length; hashes of neighbours combine by shifting the left one by the
right one's length, so chunks of a huge document are hashed as rows of their
own and folded afterwards. Rows whose fingerprints (and lengths) are equal are then
compared with the first of them chunk by chunk, byte for byte. Rows that differ
from it form a new group under the same fingerprint, which is compared in turn,
so the classes are exact whatever the hashes do.

Null texts count as empty; all empty texts are equal. A null doc_id sorts last.
Of rows with equal text and equal doc_id the first row stays. Extra columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sheafline.llm.common import cut, keyed_texts
from sheafline.operators.rows import maybe_among

CHUNK_BYTES = 1 << 16
#: Two primes below 2**31 and a base below both.
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003


def normal_text(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def chunks_of(body: Column, size: int) -> Column:
    """Byte chunks of a text; an empty text has one empty chunk."""
    raw = body.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / size))
    return F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda i: F.substring(raw, i * size + 1, F.lit(size)),
    )


def chunk_hashes(chunks: DataFrame, primes=PRIMES, base: int = BASE) -> DataFrame:
    """Adds ``h1 h2`` (hashes) and ``s1 s2`` (base to the chunk's length) to rows of ``chunk``."""
    keep = [c for c in chunks.columns if c != "chunk"]
    schema = ", ".join(
        [f"{c} {t}" for c, t in chunks.dtypes if c != "chunk"]
        + ["n long", "h1 long", "s1 long", "h2 long", "s2 long"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.ones(CHUNK_BYTES + 1, dtype=np.uint64) for _ in primes]
        for p, table in zip(primes, powers):
            done = 1
            while done < len(table):  # doubling: the table times the next power
                top = int(table[done - 1]) * base % p
                more = min(done, len(table) - done)
                table[done : done + more] = table[:more] * np.uint64(top) % np.uint64(p)
                done += more
        for b in batches:
            n, out = [], [[], [], [], []]
            for x in b.column("chunk"):
                raw = np.frombuffer(x.as_buffer(), dtype=np.uint8).astype(np.uint64)
                raw += np.uint64(1)  # so that no byte is without effect
                n.append(len(raw))
                for i, (p, table) in enumerate(zip(primes, powers)):
                    # below 2**8 * 2**31 * 2**16, so the sum does not overflow
                    out[2 * i].append(int(raw[::-1] @ table[: len(raw)]) % p)
                    out[2 * i + 1].append(int(table[len(raw)]))
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(x, pa.int64()) for x in (n, *out))],
                names=[*keep, "n", "h1", "s1", "h2", "s2"],
            )

    return chunks.mapInArrow(run, schema)


def fold(parts: Column, hash_: str, shift: str, prime: int) -> Column:
    """Hash of the whole from its chunks' in order: h = h * shift + next."""
    return F.aggregate(
        parts, F.lit(0).cast("long"), lambda acc, x: (acc * x[shift] + x[hash_]) % F.lit(prime)
    )


def fingerprints(texts: DataFrame, primes=PRIMES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The columns of ``texts`` but ``body``, which is replaced by its fingerprint ``fp``
    (struct of length and two hashes); ``row_key`` is unique."""
    if chunk_bytes > CHUNK_BYTES:
        raise ValueError(f"chunks are at most {CHUNK_BYTES} bytes")
    keep = [c for c in texts.columns if c != "body"]
    rows = texts.select(*keep, F.posexplode(chunks_of(F.col("body"), chunk_bytes)).alias("i", "chunk"))
    part = F.struct("i", "n", "h1", "s1", "h2", "s2")
    whole = (
        chunk_hashes(rows, primes)
        .groupBy(*keep)
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))  # as many as the text has chunks
    )
    return whole.select(
        *keep,
        F.struct(
            F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
            fold(F.col("parts"), "h1", "s1", primes[0]).alias("h1"),
            fold(F.col("parts"), "h2", "s2", primes[1]).alias("h2"),
        ).alias("fp"),
    )


def _unequal(members: DataFrame, chunk_bytes: int) -> DataFrame:
    """Keys of the rows of ``row_key, class, body`` that differ from their class's first row."""
    rows = members.select(
        "row_key", "class", F.posexplode(chunks_of(F.col("body"), chunk_bytes)).alias("i", "chunk")
    )
    # folded on the map side, so a class of a third of all rows sends one row a task
    first = rows.groupBy("class", "i").agg(F.min_by("chunk", "row_key").alias("first"))
    return (
        rows.join(first, ["class", "i"])
        .filter(F.col("chunk") != F.col("first"))
        .select("row_key")
        .distinct()
    )


def exact_groups(
    docs: DataFrame, primes=PRIMES, chunk_bytes: int = CHUNK_BYTES, digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``row_key``, ``doc_id``, ``keep_id``, ``group_size``,
    ``kept`` and, if asked for, ``text_sha256`` of the normalised text."""
    texts = keyed_texts(docs).withColumn("body", normal_text(F.col("text")))
    columns = ["doc_id", *(["text_sha256"] if digest else [])]
    known = texts.withColumn("text_sha256", F.sha2("body", 256)) if digest else texts
    rows = cut(fingerprints(known.select("row_key", *columns, "body"), primes, chunk_bytes))
    classes = rows.withColumn("class", F.struct("fp", F.lit(0).alias("round")))
    todo, turn = classes, 0
    while True:
        many = todo.groupBy("class").count().filter("count > 1").select("class")
        pairs = todo.join(many, "class", "left_semi").select("row_key", "class")
        bodies = maybe_among(texts.select("row_key", "body"), ["row_key"], pairs)
        unequal = cut(_unequal(bodies.join(pairs, "row_key"), chunk_bytes))
        if unequal.isEmpty():
            break
        turn += 1
        moved = unequal.withColumn("moved", F.lit(True))
        classes = cut(
            classes.join(moved, "row_key", "left").select(
                "row_key", "fp", *columns,
                F.struct(
                    "fp", F.when(F.col("moved"), turn).otherwise(F.col("class.round")).alias("round")
                ).alias("class"),
            )
        )
        todo = classes.filter(F.col("class.round") == turn)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    groups = classes.groupBy("class").agg(
        first.alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    return classes.join(groups, "class").select(
        "row_key",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_key") == F.col("first.row_key")).alias("kept"),
        *(c for c in columns if c != "doc_id"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keep = exact_groups(docs).filter("kept").select(F.col("row_key").alias("row_key_"))
    whole = docs.select(F.struct("*").alias("row_"), F.monotonically_increasing_id().alias("row_key_"))
    return whole.join(keep, "row_key_", "left_semi").select("row_.*")

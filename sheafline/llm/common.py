"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheafline.session import cut, scratch_path

#: Texts are handed on in slices of about so many characters, whatever Arrow's batches hold.
SLICE_CHARS = 8_000_000

#: Rows of few columns that make up a task, in tables much smaller than the texts.
TASK_ROWS = 100_000

FOLDS = 3
HELD_OUT = 1


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can
    import it wherever the library is installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="sheafline-")) / "sheafline.zip"  # read by the driver only
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``row_key``, ``doc_id``, ``text`` and the columns named, null texts as empty ones.

    The key tells repeated rows apart. It is the same each time a stored table
    is scanned, which is what every caller passes.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in the tasks that about so many ``rows`` need, one a core at least; nothing is shuffled for it.

    Every task of every step leaves files and a record behind however few its rows, so steps over small tables
    are not left to as many tasks as the texts' shuffles have.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // TASK_ROWS)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A stored ``df``, gathered, and its rows."""
    rows = gathered(df, 0).count()
    return gathered(df, rows), rows


def held_out(doc_id: Column) -> Column:
    """True for the fold that models never learn from; false for a null id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def map_texts(
    df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str, carry: list[str]
) -> DataFrame:
    """``carry`` columns of each row beside what ``fn`` makes of its ``text``.

    ``fn`` gets the texts of a slice and returns a list for each further column
    of ``schema``. Memory is bounded by a slice or one text, whichever is larger.
    """
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = fn(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(f.name).cast(f.type)
                        if f.name in carry
                        else pa.array(made[f.name], f.type)
                        for f in arrow
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def slices(
    batch: pa.RecordBatch, most: int = SLICE_CHARS, size: pa.Array | None = None
) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``most`` bytes of text, or one row; ``size``: the bytes of each row,
    if not those of its ``text``."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0) if size is None else size
    ends = np.cumsum(np.asarray(size, dtype="int64"))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


__all__ = ["counted", "cut", "documents", "gathered", "held_out", "keyed_texts", "map_texts", "scratch_path", "slices"]

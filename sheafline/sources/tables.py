"""Readers and writers other than the event log."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PAGE_SCHEMA = "page_id bigint, url string, html string"
# The kinds of source a description can name.
SOURCE_TYPES = ("website", "api", "database", "local_file")
_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
# Formats by extension.
_FORMATS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc"}


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt out to ``partitions`` tasks; None leaves the scan's own.

    A file of one row group is read by one task, however long the work on each
    text takes. How many tasks a small table is worth is for the caller to
    say: nothing here looks at sizes, and a large scan has row groups enough.
    """
    return df if partitions is None else df.repartition(partitions)


# Globs of landed files: the extension in any case, compressed or not.
_LANDED = {
    "csv": "*.{" + ",".join(f"[cC][sS][vV]{z}" for z in ("", ".gz", ".bz2", ".zst")) + "}",
    "json": "*.{"
    + ",".join(
        f"[jJ][sS][oO][nN]{x}{z}" for x in ("", "[lL]") for z in ("", ".gz", ".bz2", ".zst")
    )
    + "}",
}


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages, at a declared schema so that nothing is inferred."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


@dataclass(frozen=True)
class DataSource:
    """Where data lies: ``type`` is one of website, api, database, local_file."""

    type: str
    uri: str
    details: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in SOURCE_TYPES:
            raise ValueError(f"unknown source type: {self.type!r}")


def scan_source(
    spark: SparkSession, source: DataSource, schema: str | T.StructType | None = None
) -> DataFrame:
    """Read a described source.

    website: pages stored under ``uri``; api: JSON lines landed under ``uri``;
    local_file: by ``details['format']`` or extension; database: JDBC, where
    ``details`` may name a partition column with bounds to read in parallel.
    """
    details = dict(source.details)
    if source.type == "website":
        return scan_pages(spark, source.uri)
    if source.type == "database":
        return spark.read.format("jdbc").options(url=source.uri, **details).load()
    if source.type == "api":
        fmt = details.pop("format", "json")
    else:
        extension = os.path.splitext(source.uri.rstrip("/"))[1].lower()
        fmt = details.pop("format", _FORMATS.get(extension))
        if fmt is None:
            raise ValueError(f"no format known for {source.uri!r}; set details['format']")
    reader = spark.read.format(fmt).options(**details)
    return (reader.schema(schema) if schema is not None else reader).load(source.uri)


def landed_files_scan(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: str | T.StructType,
    multi_line: bool = False,
) -> DataFrame:
    """Raw csv or json files below ``path``, each row with its file name.

    Extensions count in any case, compressed (``.gz``, ``.bz2``, ``.zst``) or not, and
    ``.jsonl`` is json. ``unmatched_files`` lists what else lies there. Rows that do
    not parse keep their text in ``_corrupt_record``. With ``multi_line`` a quoted csv field may
    hold line breaks and a json record may span lines; such a file is read by one task.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"landed files are csv or json, not {fmt!r}")
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*declared.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _LANDED[fmt])
        .option("multiLine", str(multi_line).lower())
    )
    if fmt == "csv":
        reader = reader.option("header", "true").option("escape", '"')
    return reader.format(fmt).load(path).withColumn("source_file", F.col("_metadata.file_name"))


def unmatched_files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """``path`` and ``length`` of the files below ``path`` that ``landed_files_scan`` passes over."""
    every = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length")  # the contents are not read
    )
    suffix = {"csv": "csv", "json": "jsonl?"}[fmt]
    return every.filter(~F.col("path").rlike(rf"(?i)\.{suffix}(\.(gz|bz2|zst))?$"))


def table_write(
    df: DataFrame,
    name: str,
    if_exists: str = "fail",
    url: str | None = None,
    fmt: str = "parquet",
    **options: str,
) -> None:
    """Write a table; ``if_exists`` is fail, replace or append.

    ``name`` is a catalog table, a folder when it holds a '/', or a database
    table when a JDBC ``url`` is given.
    """
    if if_exists not in _MODES:
        raise ValueError(f"if_exists must be one of {sorted(_MODES)}")
    mode = _MODES[if_exists]
    if url is not None:
        df.write.mode(mode).jdbc(url, name, properties=options)
    elif "/" in name:
        df.write.mode(mode).format(fmt).options(**options).save(name)
    else:
        df.write.mode(mode).format(fmt).options(**options).saveAsTable(name)


def to_json_rows(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON object per row, in column ``json``."""
    return df.select(F.to_json(F.struct(*(cols or df.columns))).alias("json"))


def json_export(df: DataFrame, path: str, if_exists: str = "fail") -> None:
    """One JSON object per row, as line files."""
    df.write.mode(_MODES[if_exists]).json(path)

"""Declared features to a typed table, with checks on the way."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sheafline.operators.extraction import pivot_records
from sheafline.operators.ranking import first_n

# Declared dtypes and their Spark types; any other is text.
DTYPES = {
    "string": T.StringType(),
    "float": T.DoubleType(),
    "int": T.LongType(),
    "date": T.TimestampNTZType(),
}
# Fields that every table needs.
CORE_FIELDS = ("time_range", "location")


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    evidence: str = ""
    is_primary_key: bool = False

    @classmethod
    def of(cls, raw: Mapping) -> Feature:
        """From a mapping; ``description`` stands in for ``evidence``."""
        allowed = {"name", "dtype", "evidence", "description", "is_primary_key"}
        extra = set(raw) - allowed
        if extra:
            raise ValueError(f"unknown feature keys: {sorted(extra)}")
        return cls(
            raw["name"],
            raw["dtype"],
            raw.get("evidence", raw.get("description", "")),
            bool(raw.get("is_primary_key", False)),
        )

    @property
    def spark_type(self) -> T.DataType:
        return DTYPES.get(self.dtype, T.StringType())


def features_of(raw: Iterable[Feature | Mapping]) -> list[Feature]:
    return [f if isinstance(f, Feature) else Feature.of(f) for f in raw]


def primary_key(features: Iterable[Feature]) -> list[str]:
    return [f.name for f in features if f.is_primary_key]


def schema_from_features(features: Sequence[Feature]) -> T.StructType:
    """Columns in feature order; evidence and key flag go to the metadata."""
    return T.StructType(
        [
            T.StructField(
                f.name,
                f.spark_type,
                True,
                {"evidence": f.evidence, "is_primary_key": f.is_primary_key},
            )
            for f in features
        ]
    )


def empty_table(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    return spark.createDataFrame([], schema_from_features(features))


def describe_features(spark: SparkSession, features: Sequence[Feature]) -> DataFrame:
    """The declaration as a table."""
    return spark.createDataFrame(
        [asdict(f) for f in features],
        "name string, dtype string, evidence string, is_primary_key boolean",
    )


def describe_feature_sets(sets: DataFrame, key: str, features: str = "features") -> DataFrame:
    """The same for many declarations held as rows, one array each."""
    mapped = F.coalesce(
        *[
            F.when(F.col("f.dtype") == name, F.lit(dtype.simpleString()))
            for name, dtype in DTYPES.items()
        ],
        F.lit("string"),
    )
    return sets.select(key, F.posexplode(features).alias("position", "f")).select(
        key,
        "position",
        F.col("f.name").alias("name"),
        F.col("f.dtype").alias("dtype"),
        F.col("f.evidence").alias("evidence"),
        F.col("f.is_primary_key").alias("is_primary_key"),
        mapped.alias("column_type"),
    )


def core_fields_check(names: Column) -> Column:
    """Core fields that a feature name array lacks."""
    return F.array_except(F.array(*[F.lit(c) for c in CORE_FIELDS]), names)


def _with_metadata(column: Column, feature: Feature) -> Column:
    return column.alias(
        feature.name,
        metadata={"evidence": feature.evidence, "is_primary_key": feature.is_primary_key},
    )


def _missing(df: DataFrame, features: Sequence[Feature]) -> list[str]:
    return [f.name for f in features if f.name not in df.columns]


def strict_cast(feature: Feature) -> Column:
    """The column at its declared type; a value that does not fit fails."""
    raw = F.col(feature.name)
    value = raw.try_cast(feature.spark_type)
    message = F.concat(
        F.lit(f"column {feature.name} is not {feature.dtype}: "), raw.cast("string")
    )
    failed = F.raise_error(message).cast(feature.spark_type)
    return _with_metadata(
        F.when(raw.isNotNull() & value.isNull(), failed).otherwise(value), feature
    )


def cast_records(df: DataFrame, features: Sequence[Feature], mode: str = "strict") -> DataFrame:
    """Declared columns at their types.

    ``strict``: a value that does not fit, or a missing column, is an error,
    whatever the session's ANSI setting. ``try``: such values become null.
    """
    absent = _missing(df, features)
    if mode == "strict" and absent:
        raise ValueError(f"declared columns are missing: {absent}")

    if mode == "strict":
        return df.select(*[strict_cast(f) for f in features])
    return df.select(
        *[
            _with_metadata(
                F.lit(None).cast(f.spark_type)
                if f.name in absent
                else F.col(f.name).try_cast(f.spark_type),
                f,
            )
            for f in features
        ]
    )


def reject_reasons(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Add ``reasons``: missing columns, failed casts, null key fields."""
    absent = _missing(df, features)
    checks = [F.lit(f"missing:{name}") for name in absent]
    for f in features:
        if f.name in absent:
            continue
        raw = F.col(f.name)
        value = raw.try_cast(f.spark_type)
        checks.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"cast:{f.name}")))
        if f.is_primary_key:
            checks.append(F.when(raw.isNull(), F.lit(f"null_pk:{f.name}")))
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def reject_rows(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Only the rows with a reason."""
    return reject_reasons(df, features).filter(F.size("reasons") > 0)


def accepted_rows(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """The rows without a reason, typed."""
    good = reject_reasons(df, features).filter(F.size("reasons") == 0).drop("reasons")
    return cast_records(good, features, "try")


def pk_violations(table: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key values held by more than one row."""
    return table.groupBy(*pk).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(table: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The table, once its key is known to be unique; else an error."""
    found = pk_violations(table, pk).limit(5).collect()
    if found:
        raise ValueError(f"repeated primary key values, e.g. {[r.asDict() for r in found]}")
    return table


def insert_records(
    table: DataFrame, rows: DataFrame, features: Sequence[Feature], strict: bool = False
) -> DataFrame:
    """Append rows at the declared types.

    A missing declared column is an error. Undeclared columns are kept, or
    refused in strict mode.
    """
    declared = {f.name for f in features}
    extra = [c for c in rows.columns if c not in declared]
    if strict and extra:
        raise ValueError(f"undeclared columns: {extra}")
    absent = _missing(rows, features)
    if absent:
        raise ValueError(f"declared columns are missing: {absent}")
    typed = rows.select(*[strict_cast(f) for f in features], *extra)
    return table.unionByName(typed, allowMissingColumns=bool(extra))


def upsert_by_pk(
    table: DataFrame,
    rows: DataFrame,
    pk: Sequence[str],
    recency: Sequence[Column],
    table_unique: bool = False,
) -> DataFrame:
    """Table and rows together, one row per key: the first by ``recency``.

    As in SQL a key with a null equals no other, so rows with one all stay.
    ``table_unique`` promises that the table holds each full key once, which
    ``require_unique`` can check. Then only table rows whose key comes in are
    ranked, and all others pass by without that shuffle; the rows that come
    in may repeat a key, and the answer is the same either way.
    """
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pk])
    loose = table.filter(~full).unionByName(rows.filter(~full))
    new = rows.filter(full)
    if not table_unique:
        return first_n(table.filter(full).unionByName(new), pk, recency, 1).unionByName(loose)
    keys = new.select(*pk).distinct()
    held = table.filter(full)
    others = held.join(keys, list(pk), "left_anti").select(*table.columns)
    met = held.join(keys, list(pk), "left_semi").select(*table.columns)
    return others.unionByName(first_n(met.unionByName(new), pk, recency, 1)).unionByName(loose)


def fill_column(
    table: DataFrame, name: str, values: DataFrame, key: Sequence[str], value: str = "value"
) -> DataFrame:
    """Set a column from ``values`` (key, value), matched by row key.

    An unknown column is refused at once. Rows without a value, values without
    a row, and a key with several values fail the job while it runs, whichever
    columns are read from the result.
    """
    if name not in table.columns:
        raise ValueError(f"cannot fill {name!r}: the table has no such column")
    left = table.withColumn("_t", F.lit(True))
    right = values.groupBy(*key).agg(
        F.first(value).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    joined = left.join(right, list(key), "full")
    paired = F.col("_t").isNotNull() & (F.col("_n") == 1)
    checked = joined.filter(
        F.when(paired, F.lit(True)).otherwise(
            F.raise_error(F.lit("each row needs exactly one value, and each value a row")).cast("boolean")
        )
    )
    filled = F.col("_v").cast(table.schema[name].dataType)
    return checked.select(*[filled.alias(c) if c == name else F.col(c) for c in table.columns])


def target_records(
    extractions: DataFrame,
    features: Sequence[Feature],
    key: Sequence[str],
    position: Sequence[str],
) -> DataFrame:
    """Extractions as untyped records, a column per feature."""
    labels = [f.name for f in features if f.name not in key]
    return pivot_records(extractions, labels, list(key), position)


def target_assembly(
    extractions: DataFrame,
    features: Sequence[Feature],
    key: Sequence[str],
    position: Sequence[str],
    recency: Sequence[Column],
    table: DataFrame | None = None,
) -> DataFrame:
    """Extractions to the final table: pivot, drop rejects, type, one row per
    key. ``recency`` orders the rows of one key, best first. With a ``table`` of
    the same columns the records are upserted into it."""
    typed = accepted_rows(target_records(extractions, features, key, position), features)
    pk = primary_key(features)
    if not pk:
        return typed if table is None else table.unionByName(typed)
    base = typed.limit(0) if table is None else table
    return upsert_by_pk(base, typed, pk, recency)


def target_rejects(
    extractions: DataFrame,
    features: Sequence[Feature],
    key: Sequence[str],
    position: Sequence[str],
) -> DataFrame:
    """The records that ``target_assembly`` leaves out, with their ``reasons``."""
    return reject_rows(target_records(extractions, features, key, position), features)

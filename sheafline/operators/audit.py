"""Run audit and plan tables: statuses, tools, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from sheafline.functions.times import utc_instant

# The statuses a node can have.
STATUSES = ("queued", "running", "succeeded", "failed", "unknown")


def known_status(status: Column) -> Column:
    """The status, or ``unknown`` where it is not one of the five."""
    return F.when(status.isin(*STATUSES), status).otherwise(F.lit("unknown"))


def audit_rows(df: DataFrame) -> DataFrame:
    """Rows of the audit table: columns in order, statuses in the known set.
    A ``result`` belongs to a success and an error to a failure; others have neither."""
    status = known_status(F.col("status"))
    result = F.col("result") if "result" in df.columns else F.lit(None).cast("string")
    return df.select(
        "plan_id",
        F.coalesce("branch_id", F.lit("")).alias("branch_id"),
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        "node_id",
        status.alias("status"),
        F.when(status == "succeeded", result).alias("result"),
        "error",
        "at",
    )


def audit_sink(df: DataFrame, path: str) -> None:
    """Append audit rows, a folder per plan; AQE splits a plan with many rows
    and packs those with few, so that files come out even."""
    audit_rows(df).hint("rebalance", "plan_id").write.mode("append").partitionBy("plan_id").parquet(path)


def _ticks(df: DataFrame, name: str) -> Column:
    """A time column as a whole number that keeps its order."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(utc_instant(F.col(name)))
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(name)
    return F.col(name).cast("bigint")


def run_status_counts(audit: DataFrame) -> DataFrame:
    """Nodes per last status and run, a column per status. A node counts once,
    however many rows it has."""
    last = latest_status(audit)
    return last.groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


# Of two statuses at one time the later one here counts: a status that is not
# known never wins against one that is.
_TIES = ("unknown", "queued", "running", "succeeded", "failed")


def latest_status(audit: DataFrame) -> DataFrame:
    """Last status of each node of a run, and when it first started.

    Time and status are packed into one number, so the fold is a plain hash
    aggregation that starts on the map side.
    """
    names = F.array(*[F.lit(s) for s in _TIES])
    status = known_status(F.col("status"))
    packed = _ticks(audit, "at") * 8 + F.array_position(names, status)
    return (
        audit.groupBy("run_id", "node_id")
        .agg(
            F.max(packed).alias("_last"),
            F.max("at").alias("at"),
            F.min(F.when(status == "running", F.col("at"))).alias("started_at"),
        )
        .select(
            "run_id",
            "node_id",
            F.element_at(names, F.pmod("_last", F.lit(8)).cast("int")).alias("status"),
            "at",
            "started_at",
        )
    )


def start_order(audit: DataFrame) -> DataFrame:
    """The nodes of each run that started, numbered from 1 in the order of their
    first start, by name where two started together. A run is one plan's nodes."""
    started = latest_status(audit).filter(F.col("started_at").isNotNull())
    order = W.partitionBy("run_id").orderBy("started_at", "node_id")
    return started.select(
        "run_id", "node_id", "started_at", F.row_number().over(order).cast("bigint").alias("seq")
    )


def unknown_refs(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """Steps whose tool is not registered."""
    names = tools.select(F.col("name").alias("tool_name")).distinct()
    return steps.join(names, "tool_name", "left_anti")


def known_refs(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """Steps with their tool's description."""
    summary = tools.select(
        F.col("name").alias("tool_name"), F.col("description").alias("tool_description")
    )
    return steps.join(summary, "tool_name")


def edge_table(steps: DataFrame) -> DataFrame:
    """One row per declared input: ``src`` feeds ``dst``."""
    return steps.select(F.explode("inputs_from").alias("src"), F.col("id").alias("dst"))


def undeclared_inputs(steps: DataFrame) -> DataFrame:
    """Edges that come from a step nobody declared."""
    return edge_table(steps).join(steps.select(F.col("id").alias("src")), "src", "left_anti")


def plan_indegree(steps: DataFrame) -> DataFrame:
    """Steps with the number of inputs they wait for; roots have 0.

    The inputs are the step's own array, so this is a projection.
    """
    distinct = F.array_distinct(F.coalesce("inputs_from", F.array().cast("array<string>")))
    return steps.select("id", F.size(distinct).alias("indegree"))

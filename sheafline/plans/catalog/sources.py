"""Scans and sinks. Sinks write to the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import audit
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query
from sheafline.session import scratch_path
from sheafline.sources import tables as S


@query(
    "scan_pages",
    "SELECT page_id, url, length(html) AS html_chars FROM pages",
)
def scan_pages(spark, sf):
    return S.scan_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("html_chars")
    )


@query("scan_source", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_source(spark, sf):
    return S.scan_source(spark, S.DataSource("local_file", f"{sf}/supplier.parquet"))


_CSV = "c_custkey bigint, c_name string, c_mktsegment string"


@query("landed_files_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def landed_files_scan(spark, sf):
    """Customers landed as csv, and read back at a declared schema."""
    path = scratch_path(spark, "landed")
    columns = ["c_custkey", "c_name", "c_mktsegment"]
    V.table(spark, sf, "customer").select(*columns).write.csv(path, header=True, escape='"')
    return S.landed_files_scan(spark, path, "csv", _CSV).select(*columns)


@query(
    "table_write",
    """SELECT n_nationkey, n_name FROM nation
       UNION ALL SELECT s_nationkey, s_name FROM supplier""",
)
def table_write(spark, sf):
    """Replace, then append."""
    path = scratch_path(spark, "table")
    nations = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    suppliers = V.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("n_name")
    )
    S.table_write(nations, path, "fail")
    S.table_write(nations, path, "replace")
    S.table_write(suppliers, path, "append")
    return spark.read.schema("n_nationkey int, n_name string").parquet(path)


@query(
    "json_export",
    """SELECT CAST(json_object('doc_id', doc_id, 'lang', lang, 'text', text) AS VARCHAR) AS json
       FROM documents""",
)
def json_export(spark, sf):
    return S.to_json_rows(V.texts(spark, sf), "doc_id", "lang", "text")


@query(
    "audit_sink",
    f"""WITH {Q.RUN_AUDIT}
        SELECT plan_id, branch_id, run_id, node_id, status, error, "at" FROM run_audit""",
)
def audit_sink(spark, sf):
    path = scratch_path(spark, "audit")
    audit.audit_sink(V.run_audit(spark, sf), path)
    schema = (
        "branch_id string, run_id string, node_id string, status string, error string, "
        "at timestamp_ntz, plan_id string"
    )
    return spark.read.schema(schema).parquet(path)

"""Inputs the catalogue's queries work on, derived by Spark from the tables.

The tables hold web pages, texts and trade rows but no search results, robots
rules, plans or requests; each view derives those from the rows at hand, so it
grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheafline.functions import urls as U
from sheafline.operators import web
from sheafline.operators.extraction import LabelPattern
from sheafline.operators.tables import Feature
from sheafline.sources.tables import scan_pages, spread

AGENT = "harvestbot/1.0 (+https://harvest.example.org)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tasks(spark: SparkSession) -> int | None:
    """Tasks that a table in one small file is dealt out to, if the session says so."""
    found = spark.conf.get("spark.sheafline.scanTasks", None)
    return int(found) if found else None


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table whose rows each take long to work on."""
    return spread(table(spark, sf, name), tasks(spark))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(scan_pages(spark, f"{sf}/pages.parquet"), tasks(spark))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return web.with_text(pages(spark, sf))


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as hits: the query is language segment and kind of host, the
    address is cut to the site section, so that it repeats."""
    url = F.col("url")
    return pages(spark, sf).select(
        F.concat(
            F.regexp_extract(url, r"^[a-z]+://[^/]*/([^/?#]*)", 1),
            F.lit(" "),
            F.regexp_extract(url, r"^[a-z]+://([^.]*)\.", 1),
        ).alias("query"),
        F.concat(F.lit("p"), F.col("page_id") % 4).alias("provider"),
        (F.col("page_id") % 4).alias("provider_order"),
        (F.floor(F.col("page_id") / 4) + 1).alias("rank"),
        F.regexp_extract(url, r"^([a-z]+://[^/]*/[^/?#]*)", 1).alias("url"),
    )


def robots_status(spark: SparkSession, sf: str) -> DataFrame:
    origin = U.url_origin(F.col("url"))
    kind = F.length("origin") % 10
    return (
        pages(spark, sf)
        .select(origin.alias("origin"))
        .distinct()
        .select(
            "origin",
            F.when(kind == 0, 401)
            .when(kind == 1, 404)
            .when(kind == 2, 503)
            .when(kind == 3, F.lit(None))
            .otherwise(200)
            .cast("int")
            .alias("status"),
        )
    )


# agent, position, allow, path; the named group only for every other origin
_RULES = [
    ("*", 1, False, "/de"),
    ("*", 2, True, "/de/1"),
    ("*", 3, True, "/en/1"),
    ("*", 4, False, "/en"),
    ("*", 5, False, ""),
    ("otherbot", 6, False, "/"),
    ("HarvestBot", 7, False, "/fr/2"),
    ("HarvestBot", 8, True, "/en/3"),
    ("HarvestBot", 9, False, "/en"),
]


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = F.array(
        *[
            F.struct(
                F.lit(a).alias("agent"),
                F.lit(p).alias("position"),
                F.lit(ok).alias("allow"),
                F.lit(path).alias("path"),
            )
            for a, p, ok, path in _RULES
        ]
    )
    return (
        robots_status(spark, sf)
        .filter("status = 200")
        .select("origin", F.explode(rules).alias("r"))
        .select("origin", "r.*")
        .filter((F.col("agent") != "HarvestBot") | (F.length("origin") % 2 == 0))
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("id"),
        F.col("event_type").alias("topic"),
        F.col("props").alias("payload"),
        F.col("ts").alias("created_at"),
    )


def consumer_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """One reader per topic, at its last event before the 20th; the reader of
    ``view`` has no offset yet."""
    return (
        event_log(spark, sf)
        .filter("topic <> 'view' and created_at < timestamp_ntz'2024-01-20 00:00:00'")
        .groupBy("topic")
        .agg(F.max("id").alias("last_id"))
        .select(F.concat(F.lit("reader_"), "topic").alias("consumer"), "last_id")
    )


def readers(spark: SparkSession, sf: str) -> DataFrame:
    return (
        event_log(spark, sf)
        .select("topic")
        .distinct()
        .select(F.concat(F.lit("reader_"), "topic").alias("consumer"), "topic")
    )


def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Events as node statuses; purchases carry a status that does not exist."""
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "view", "running")
        .when(F.col("event_type") == "click", "succeeded")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("archived")
    )
    return table(spark, sf, "events").select(
        F.concat(F.lit("plan-"), F.col("user_id") % 3).alias("plan_id"),
        F.lit("default").alias("branch_id"),
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("n"), F.col("event_id") % 5).alias("node_id"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("ts").alias("at"),
    )


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Eight orders in a row make a plan: step n takes the output of step n/2,
    and of step n-1 when the order is finished; every 11th plan also names a
    step nobody declared."""
    plan = F.floor(F.col("o_orderkey") / 8)
    line = F.col("o_orderkey") % 8 + 1

    def step(n):
        return F.concat(plan, F.lit("-"), n)

    return table(spark, sf, "orders").select(
        step(line).alias("id"),
        F.concat(F.lit("tool-"), "o_custkey").alias("tool_name"),
        F.array_compact(
            F.array(
                F.when(line > 1, step(F.floor(line / 2))),
                F.when((line > 1) & (F.col("o_orderstatus") == "F"), step(line - 1)),
                F.when(plan % 11 == 0, F.concat(plan, F.lit("-x"))),
            )
        ).alias("inputs_from"),
    )


def declared_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the undeclared inputs."""
    return steps(spark, sf).withColumn(
        "inputs_from", F.filter("inputs_from", lambda s: ~s.endswith("-x"))
    )


def tools(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in credit are the registered tools."""
    return (
        table(spark, sf, "customer")
        .filter("c_acctbal >= 0")
        .select(
            F.concat(F.lit("tool-"), "c_custkey").alias("name"),
            F.col("c_name").alias("description"),
        )
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: events, error share, spend; text value: the last kind seen."""
    per_user = (
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(
            F.count("*").cast("double").alias("events"),
            (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"),
            F.sum(
                F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100))
                .otherwise(0)
                .cast("bigint")
            )
            .cast("double")
            .alias("spend_cents"),
            F.max(F.struct("event_id", "event_type"))["event_type"].alias("last_kind"),
        )
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                F.col(n).alias("value"),
                F.lit(None).cast("string").alias("value_str"),
            )
            for n in ("events", "error_rate", "spend_cents")
        ],
        F.struct(
            F.lit("last_kind").alias("name"),
            F.lit(None).cast("double").alias("value"),
            F.col("last_kind").alias("value_str"),
        ),
    )
    return per_user.select("user_id", F.explode(cells).alias("m")).select("user_id", "m.*")


# name, threshold, op: all operators, no op, and a metric nobody measures
CRITERIA = [
    ("events", 60.0, ">="),
    ("events", 80.0, "<"),
    ("error_rate", 0.2, "<="),
    ("error_rate", 0.25, ">"),
    ("spend_cents", 0.0, "=="),
    ("spend_cents", 50000.0, None),
    ("freshness", 1.0, "<="),
    ("freshness", 1.0, ">="),
]


def criteria(spark: SparkSession, sf: str, threshold: str) -> DataFrame:
    """Goals or guards: every user has each criterion."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(t).alias(threshold), F.lit(o).alias("op"))
            for n, t, o in CRITERIA
        ]
    )
    return (
        table(spark, sf, "events")
        .select("user_id")
        .distinct()
        .select("user_id", F.explode(rows).alias("g"))
        .select("user_id", "g.*")
    )


def metric_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as metric specs, with half-filled and wrong benchmarks."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(n) for n in ("events", "error_rate", "spend_cents", "last_kind")])
    ops = F.array(*[F.lit(o) for o in ("<=", "<", ">=", ">", "==", "!=")])
    return table(spark, sf, "part").select(
        k.alias("spec_id"),
        (k % 150).alias("user_id"),
        F.element_at(names, (k % 4 + 1).cast("int")).alias("name"),
        F.col("p_name").alias("description"),
        F.when(k % 7 != 0, F.element_at(ops, (k % 6 + 1).cast("int"))).alias("comparator"),
        F.when((k % 4 != 3) & (k % 5 != 0), F.col("p_size").cast("double")).alias("target_num"),
        F.when(k % 4 == 3, F.lit("click")).alias("target_str"),
    )


def requirements(spark: SparkSession, sf: str) -> DataFrame:
    """A request per customer, with blanks, nulls and scopes that do not exist."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return c.select(
        k.alias("req_id"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, " \t").otherwise("1995-01-01")
        .alias("time_start"),
        F.when(k % 6 == 0, F.lit(None)).otherwise("1996-12-31").alias("time_end"),
        F.when(k % 8 == 0, "").otherwise(F.col("n_name")).alias("area_value"),
        F.lower("c_mktsegment").alias("entity_type"),
        F.when(k % 11 == 0, "regional")
        .when(k % 3 == 0, F.lit(None))
        .when(k % 3 == 1, "global")
        .otherwise("local")
        .alias("scope"),
        F.when(k % 4 == 0, F.lit(None)).otherwise("prices").alias("topic"),
        F.when(k % 13 == 0, F.array(F.lit("colour"), F.lit("size")))
        .otherwise(F.array().cast("array<string>"))
        .alias("unknown_keys"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from customers; every fourth is null and changes nothing."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("req_id"),
        F.explode(F.array(F.lit("time_start"), F.lit("area_value"))).alias("field"),
        F.when(k % 4 != 0, F.concat(F.lit("answer "), "c_name")).alias("answer"),
    )


def price_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(ts, area, price): line prices by order day and customer nation."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").alias("ts"),
            F.col("n_name").alias("area"),
            F.col("l_extendedprice").alias("price"),
        )
    )


def price_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for each area: a span by days, the same by years, one that is
    open at its start; two without an area test for the first areas, of which one is
    open on both sides; and one whose end cannot be read."""
    kinds = [
        (0, "local", "1995-01-01", "1996-12-31"),
        (1, None, "1995", "1996"),
        (2, "local", None, "1995-06"),
        (3, "global", " ", ""),
        (4, "global", "1997-03-05 00:00:00", "1997-03"),
        (5, "local", "1995", "soon"),
    ]
    each = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"), F.lit(scope).cast("string").alias("scope"),
                F.lit(start).cast("string").alias("time_start"), F.lit(end).alias("time_end"),
            )
            for k, scope, start, end in kinds
        ]
    )
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", F.explode(each).alias("k"))
    return rows.filter("k.kind not in (3, 4) or n_nationkey < 2").select(
        (F.col("n_nationkey") * 8 + F.col("k.kind")).cast("bigint").alias("req_id"),
        F.col("n_name").alias("area_value"),
        "k.scope", "k.time_start", "k.time_end",
    )


ORDER_FEATURES = [
    Feature("order_id", "int", "order number", True),
    Feature("cents", "float", "total in cents"),
    Feature("ordered", "date", "order date"),
    Feature("priority", "string", "priority class"),
    Feature("state", "money", "a dtype that is not known"),
]


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text, with values that do not cast and null or repeated keys."""
    k = F.col("o_orderkey")
    key = F.when(k % 101 == 0, F.lit(None)).when(k % 103 == 0, (k + 1).cast("string"))
    return table(spark, sf, "orders").select(
        key.otherwise(k.cast("string")).alias("order_id"),
        F.when(k % 97 == 0, "n/a")
        .otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"))
        .alias("cents"),
        F.when(k % 89 == 0, "soon")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("ordered"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("state"),
        k.alias("src_key"),
    )


def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    """The same where every value casts."""
    return raw_records(spark, sf).filter(
        "order_id is not null and cents <> 'n/a' and ordered <> 'soon'"
    )


def feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A feature declaration per customer; some lack a core field."""
    k = F.col("c_custkey")

    def feature(name, dtype, evidence, pk):
        return F.struct(
            name.alias("name"),
            dtype.alias("dtype"),
            evidence.alias("evidence"),
            pk.alias("is_primary_key"),
        )

    kinds = F.array(*[F.lit(x) for x in ("string", "float", "int", "date", "money")])
    return table(spark, sf, "customer").select(
        k.alias("set_id"),
        F.array_compact(
            F.array(
                F.when(
                    k % 3 != 0,
                    feature(F.lit("time_range"), F.lit("date"), F.lit("span"), F.lit(True)),
                ),
                feature(
                    F.lower("c_mktsegment"),
                    F.element_at(kinds, (k % 5 + 1).cast("int")),
                    F.col("c_name"),
                    F.lit(False),
                ),
                F.when(
                    k % 4 != 0,
                    feature(F.lit("location"), F.lit("string"), F.lit("place"), F.lit(True)),
                ),
            )
        ).alias("features"),
    )


# Patterns whose matches occur in the documents.
LABEL_PATTERNS = {
    "email": LabelPattern(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", needs="@"),
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "phone": LabelPattern(r"\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b", needs="-"),
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
}


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot examples: a 60-word block and its first, 10th and last word;
    swapped, repeated, ungrounded or relabelled by document."""
    from sheafline.functions.chunks import chunk_fixed
    from sheafline.functions.text import words

    d = F.col("doc_id")
    blocks = web.chunk_rows(
        texts(spark, sf), chunk_fixed(F.col("text"), 60), ["doc_id"]
    ).select("doc_id", "chunk_idx", "text", words(F.col("text")).alias("w"))

    def pair(label, value):
        return F.struct(label.alias("label"), value.alias("value"))

    first = pair(F.lit("first"), F.element_at("w", 1))
    tenth = pair(
        F.when(d % 5 == 1, F.lit("Tenth")).otherwise(F.lit("tenth")),
        F.when(d % 7 == 2, F.lit("@none@")).otherwise(F.coalesce(F.get("w", F.lit(9)), F.lit(""))),
    )
    last = pair(F.lit("last"), F.element_at("w", -1))
    return blocks.select(
        "doc_id",
        "chunk_idx",
        "text",
        F.when(d % 3 == 1, F.array(tenth, first, last))
        .when(d % 11 == 5, F.array(first, tenth, last, last))
        .otherwise(F.array(first, tenth, last))
        .alias("extractions"),
    )


def labelled_examples(spark: SparkSession, sf: str, half: int = 0) -> DataFrame:
    """Every other document with the values that ``LABEL_PATTERNS`` find in it, as example rows."""
    from sheafline.operators.extraction import extract_labels

    docs = texts(spark, sf).filter(F.col("doc_id") % 2 == half)
    found = extract_labels(docs, LABEL_PATTERNS, ["doc_id"]).groupBy("doc_id").agg(
        F.collect_list(
            F.struct(F.col("extraction_class").alias("label"), F.col("extraction_text").alias("value"))
        ).alias("extractions")
    )
    none = F.array().cast("array<struct<label:string,value:string>>")
    rows = docs.select("doc_id", "text").join(found, "doc_id", "left")
    return rows.withColumn("extractions", F.coalesce("extractions", none))

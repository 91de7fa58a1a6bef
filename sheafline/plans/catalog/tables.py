"""Declared features, typed tables, and the jobs that end in one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions.chunks import chunk_fixed
from sheafline.operators import quality
from sheafline.operators import tables as T
from sheafline.operators import web
from sheafline.operators.requirements import feature_names
from sheafline.plans import fragments as Q
from sheafline.plans import harvest
from sheafline.plans import views as V
from sheafline.plans.registry import query
from sheafline.session import scratch_path
from sheafline.sources import keyedtable


@query("schema_from_features", f"WITH {Q.RAW_RECORDS} SELECT {Q.TYPED} FROM clean_records")
def schema_from_features(spark, sf):
    """An empty table of the declared schema takes the typed orders."""
    table = T.empty_table(spark, V.ORDER_FEATURES)
    return table.unionByName(T.cast_records(V.clean_records(spark, sf), V.ORDER_FEATURES))


@query(
    "describe_features",
    f"""WITH {Q.FEATURE_SETS}
        SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY o) - 1 AS position,
          name, dtype, evidence, is_primary_key,
          CASE dtype WHEN 'float' THEN 'double' WHEN 'int' THEN 'bigint'
                     WHEN 'date' THEN 'timestamp_ntz' ELSE 'string' END AS column_type
        FROM feature_rows""",
)
def describe_features(spark, sf):
    return T.describe_feature_sets(V.feature_sets(spark, sf), "set_id").withColumn(
        "position", F.col("position").cast("bigint")
    )


@query(
    "core_fields_check",
    """SELECT c_custkey AS set_id, concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'time_range' END,
              CASE WHEN c_custkey % 4 = 0 THEN 'location' END) AS missing FROM customer""",
)
def core_fields_check(spark, sf):
    missing = T.core_fields_check(feature_names(F.col("features")))
    return V.feature_sets(spark, sf).select("set_id", F.array_join(missing, ",").alias("missing"))


@query(
    "cast_records",
    f"""WITH {Q.RAW_RECORDS}
        SELECT TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(cents AS DOUBLE) AS cents,
               TRY_CAST(ordered AS TIMESTAMP) AS ordered, priority, state FROM raw_records""",
)
def cast_records(spark, sf):
    return T.cast_records(V.raw_records(spark, sf), V.ORDER_FEATURES, "try")


@query(
    "reject_rows",
    f"""WITH {Q.RAW_RECORDS}, r AS (
          SELECT src_key, concat_ws('|', 'missing:currency',
            CASE WHEN order_id IS NULL THEN 'null_pk:order_id' END,
            CASE WHEN TRY_CAST(cents AS DOUBLE) IS NULL THEN 'cast:cents' END,
            CASE WHEN TRY_CAST(ordered AS TIMESTAMP) IS NULL THEN 'cast:ordered' END) AS reasons
          FROM raw_records)
        SELECT src_key, reasons FROM r WHERE reasons <> ''""",
)
def reject_rows(spark, sf):
    declared = [T.Feature("currency", "string"), *V.ORDER_FEATURES]
    return T.reject_rows(V.raw_records(spark, sf), declared).select(
        "src_key", F.array_join("reasons", "|").alias("reasons")
    )


@query(
    "accepted_rows",
    f"""WITH {Q.RAW_RECORDS} SELECT {Q.TYPED} FROM clean_records""",
)
def accepted_rows(spark, sf):
    return T.accepted_rows(V.raw_records(spark, sf), V.ORDER_FEATURES)


@query(
    "pk_violations",
    f"""WITH {Q.RAW_RECORDS}
        SELECT order_id, CAST(count(*) AS BIGINT) AS n FROM raw_records
        GROUP BY order_id HAVING count(*) > 1""",
)
def pk_violations(spark, sf):
    return T.pk_violations(V.raw_records(spark, sf), ["order_id"])


@query(
    "insert_records",
    f"""WITH {Q.RAW_RECORDS}
        SELECT {Q.TYPED}, CASE WHEN state <> 'F' THEN src_key END AS src_key
        FROM clean_records""",
)
def insert_records(spark, sf):
    """Finished orders are the table; the others come in with an undeclared column."""
    clean = V.clean_records(spark, sf)
    table = T.cast_records(clean.filter("state = 'F'"), V.ORDER_FEATURES)
    return T.insert_records(table, clean.filter("state <> 'F'"), V.ORDER_FEATURES)


@query(
    "upsert_by_pk",
    f"""WITH {Q.RAW_RECORDS}, a AS (
          SELECT order_id, cents, 1 AS version, src_key FROM clean_records
          UNION ALL SELECT order_id, '7', 2, src_key FROM clean_records WHERE state = 'F')
        SELECT order_id, cents, CAST(version AS BIGINT) AS version, src_key FROM (
          SELECT *, row_number() OVER (PARTITION BY order_id
                                       ORDER BY version DESC, src_key DESC) AS rn FROM a)
        WHERE rn = 1""",
)
def upsert_by_pk(spark, sf):
    clean = V.clean_records(spark, sf)
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    table = clean.select("order_id", "cents", one.alias("version"), "src_key")
    rows = clean.filter("state = 'F'").select(
        "order_id", F.lit("7").alias("cents"), two.alias("version"), "src_key"
    )
    return T.upsert_by_pk(
        table, rows, ["order_id"], [F.col("version").desc(), F.col("src_key").desc()]
    )


@query(
    "upsert_null_keys",
    f"""WITH {Q.RAW_RECORDS}, a AS (
          SELECT order_id, 1 AS version, src_key FROM raw_records
          UNION ALL SELECT order_id, 2, src_key FROM raw_records WHERE state = 'F')
        SELECT order_id, version, src_key FROM a
        QUALIFY order_id IS NULL OR row_number() OVER
          (PARTITION BY order_id ORDER BY version DESC, src_key DESC) = 1""",
)
def upsert_null_keys(spark, sf):
    """Raw records, some without a key and some with a repeated one."""
    raw = V.raw_records(spark, sf)
    table = raw.select("order_id", F.lit(1).alias("version"), "src_key")
    rows = raw.filter("state = 'F'").select("order_id", F.lit(2).alias("version"), "src_key")
    return T.upsert_by_pk(
        table, rows, ["order_id"], [F.col("version").desc(), F.col("src_key").desc()]
    )


@query(
    "upsert_few_rows",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS state,
              CASE WHEN o_totalprice > 450000 THEN 2 ELSE 1 END AS version FROM orders
       UNION ALL
       SELECT -1 - o_orderkey, 'N', 2 FROM orders WHERE o_totalprice > 450000""",
)
def upsert_few_rows(spark, sf):
    """A small batch into a table whose key is known to be unique: the dearest
    orders get a newer version, stale rows lose, new orders are added."""
    orders = V.table(spark, sf, "orders")
    key = F.col("o_orderkey")

    def versions(some, key, state, version):
        return some.select(
            key.alias("o_orderkey"), state.alias("state"), F.lit(version).alias("version")
        )

    table = versions(orders, key, F.col("o_orderstatus"), 1)
    dear = orders.filter("o_totalprice > 450000")
    newer = versions(dear, key, F.lit("X"), 2)
    stale = versions(orders.filter("o_totalprice < 5000"), key, F.lit("old"), 0)
    new = versions(dear, -1 - key, F.lit("N"), 2)
    return T.upsert_by_pk(
        table,
        newer.union(stale).union(new),
        ["o_orderkey"],
        [F.col("version").desc()],
        table_unique=True,
    )


@query(
    "fill_column",
    f"""WITH {Q.RAW_RECORDS}
        SELECT src_key, cents, o_orderpriority || '/' || o_orderstatus AS state
        FROM raw_records JOIN orders ON src_key = o_orderkey""",
)
def fill_column(spark, sf):
    values = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("src_key"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("value"),
    )
    filled = T.fill_column(V.raw_records(spark, sf), "state", values, ["src_key"])
    return filled.select("src_key", "cents", "state")


_TARGET = [
    T.Feature("source", "string", "", True),
    T.Feature("doc_id", "int"),
    T.Feature("email", "string"),
    T.Feature("ipv4", "string"),
    T.Feature("card", "int", "only plain digits fit"),
]


@query(
    "target_assembly",
    f"""WITH docs AS (SELECT doc_id, source, text FROM documents), {Q.extractions('docs')},
        p AS (SELECT doc_id,
                arg_min(extraction_text, nth) FILTER (extraction_class = 'email') AS email,
                arg_min(extraction_text, nth) FILTER (extraction_class = 'ipv4') AS ipv4,
                arg_min(extraction_text, nth) FILTER (extraction_class = 'card') AS card
              FROM found GROUP BY doc_id),
        g AS (SELECT source, p.* FROM p JOIN documents USING (doc_id)
              WHERE card IS NULL OR TRY_CAST(card AS BIGINT) IS NOT NULL)
        SELECT source, doc_id, email, ipv4, CAST(card AS BIGINT) AS card FROM g
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""",
)
def target_assembly(spark, sf):
    from sheafline.operators.extraction import extract_labels

    docs = V.texts(spark, sf).select("source", "doc_id", "text")
    found = extract_labels(docs, V.LABEL_PATTERNS, ["source", "doc_id"])
    return T.target_assembly(
        found, _TARGET, ["source", "doc_id"], ["nth"], [F.col("doc_id").desc()]
    )


@query(
    "target_rejects",
    f"""WITH docs AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN
              regexp_replace(text, '([0-9]{{4}})([0-9]{{4}})([0-9]{{4}})([0-9]{{4}})', '\\1-\\2-\\3-\\4', 'g')
              ELSE text END AS text FROM documents), {Q.extractions('docs')},
        p AS (SELECT doc_id, arg_min(extraction_text, nth) FILTER (extraction_class = 'card') AS card
              FROM found GROUP BY doc_id)
        SELECT source, doc_id, card, concat_ws('|',
            CASE WHEN source IS NULL THEN 'null_pk:source' END,
            CASE WHEN TRY_CAST(card AS BIGINT) IS NULL AND card IS NOT NULL THEN 'cast:card' END) AS reasons
        FROM p JOIN documents USING (doc_id)
        WHERE source IS NULL OR (card IS NOT NULL AND TRY_CAST(card AS BIGINT) IS NULL)""",
)
def target_rejects(spark, sf):
    """Every third document's card numbers are written in groups, which is no integer."""
    from sheafline.operators.extraction import extract_labels

    grouped = F.regexp_replace(
        "text", "([0-9]{4})([0-9]{4})([0-9]{4})([0-9]{4})", "$1-$2-$3-$4"
    )
    docs = V.texts(spark, sf).select(
        "source", "doc_id",
        F.when(F.col("doc_id") % 3 == 0, grouped).otherwise(F.col("text")).alias("text"),
    )
    found = extract_labels(docs, V.LABEL_PATTERNS, ["source", "doc_id"])
    rejects = T.target_rejects(found, _TARGET, ["source", "doc_id"], ["nth"])
    return rejects.select("source", "doc_id", "card", F.array_join("reasons", "|").alias("reasons"))


@query(
    "text_per_host",
    f"""WITH t AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
            {Q.sentence_list(Q.page_text('html'))} AS c FROM pages)
        SELECT host, CAST(count(*) AS BIGINT) AS pages, CAST(sum(len(c)) AS BIGINT) AS chunks,
               round(sum(list_sum(list_transform(c, lambda x: length(x)))) / sum(len(c)), 6)
                 AS mean_chunk_chars
        FROM t GROUP BY host""",
)
def text_per_host(spark, sf):
    return harvest.text_per_host(V.pages(spark, sf)).withColumn(
        "mean_chunk_chars", F.round("mean_chunk_chars", 6)
    )


_FULL_RESULTS = Q.SEARCH_RESULTS.replace(
    "regexp_extract(url, '^([a-z]+://[^/]*/[^/?#]*)', 1) AS url", "url"
)


@query(
    "harvest_chunks",
    f"""WITH {_FULL_RESULTS}, {Q.ROBOTS}, {Q.allowed('pages')},
        f AS (SELECT *, min(provider_order) OVER (PARTITION BY query) AS first_order,
                row_number() OVER (PARTITION BY query, provider_order ORDER BY rank, url) AS rn
              FROM search_results),
        hits AS (SELECT query, rank, url FROM f
                 WHERE provider_order = first_order AND rn <= 4),
        chosen AS (SELECT query, min(rank) AS rank, url FROM hits JOIN decided USING (url)
                   WHERE allowed GROUP BY query, url),
        t AS (SELECT query, rank, p.page_id, url, {Q.sentence_list(Q.page_text('html'))} AS c
              FROM chosen JOIN (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html
                                FROM pages GROUP BY url) p USING (url))
        SELECT query, rank, page_id, url, unnest(range(len(c))) AS chunk_idx, unnest(c) AS text
        FROM t""",
)
def harvest_chunks(spark, sf):
    pages = V.pages(spark, sf)
    # the same hits with the page's own address
    results = pages.select(
        F.concat(
            F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]*)", 1),
            F.lit(" "),
            F.regexp_extract("url", r"^[a-z]+://([^.]*)\.", 1),
        ).alias("query"),
        (F.col("page_id") % 4).alias("provider_order"),
        (F.floor(F.col("page_id") / 4) + 1).alias("rank"),
        "url",
    )
    chunks = harvest.harvest_chunks(
        results, V.robots_status(spark, sf), V.robots_rules(spark, sf), pages, V.AGENT, 4
    )
    return chunks.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


_RECORD = [
    T.Feature("doc_id", "int", "", True),
    T.Feature("email", "string"),
    T.Feature("phone", "string"),
    T.Feature("ipv4", "string"),
]


@query(
    "harvest_records",
    f"""WITH w AS (SELECT doc_id, {Q.word_list('text')} AS w FROM documents),
        blocks AS (SELECT doc_id AS d, i, array_to_string(w[i + 1 : i + 100], ' ') AS text
                   FROM (SELECT doc_id, w, unnest(range(0, len(w), 100)) AS i FROM w)),
        docs AS (SELECT d * 100000 + i AS doc_id, text FROM blocks), {Q.extractions('docs')}
        SELECT doc_id // 100000 AS doc_id,
          arg_min(extraction_text, (doc_id % 100000) * 10000 + nth)
            FILTER (extraction_class = 'email') AS email,
          arg_min(extraction_text, (doc_id % 100000) * 10000 + nth)
            FILTER (extraction_class = 'phone') AS phone,
          arg_min(extraction_text, (doc_id % 100000) * 10000 + nth)
            FILTER (extraction_class = 'ipv4') AS ipv4
        FROM found GROUP BY ALL""",
)
def harvest_records(spark, sf):
    chunks = web.chunk_rows(
        V.texts(spark, sf), chunk_fixed(F.col("text")), ["doc_id"]
    )
    return harvest.harvest_records(chunks, V.LABEL_PATTERNS, _RECORD, ["doc_id"])


@query(
    "stored_upsert",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' WHEN o_orderkey % 3 = 0 THEN 'late'
                ELSE o_orderstatus END AS state,
              CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version
       FROM orders
       UNION ALL SELECT -1 - o_orderkey, 'N', 3 FROM orders WHERE o_totalprice > 300000""",
)
def stored_upsert(spark, sf):
    """Three batches into one stored table: all orders but some, those with stale rows of others, and the
    dearest with new orders."""
    path = scratch_path(spark, "orders")
    orders = V.table(spark, sf, "orders")
    newest = [F.col("version").desc()]

    def batch(some, key, state, version):
        rows = some.select(key.alias("o_orderkey"), state.alias("state"), F.lit(version).alias("version"))
        return keyedtable.upsert(rows, path, ["o_orderkey"], newest, buckets=16)

    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    batch(orders.filter("o_orderkey % 3 <> 0"), key, state, 1)
    batch(orders.filter("o_orderkey % 3 = 0"), key, F.lit("late"), 2)
    batch(orders.filter("o_orderkey % 5 = 0"), key, F.lit("stale"), 0)
    dear = orders.filter("o_totalprice > 300000")
    both = dear.select(key.alias("k"), F.lit("X").alias("s")).union(dear.select(-1 - key, F.lit("N")))
    batch(both, F.col("k"), F.col("s"), 3)
    return keyedtable.read(spark, path)


@query(
    "metric_kept",
    f"""WITH {Q.PRICE_FACTS}
        SELECT strftime(ts, '%Y-%m-%d') AS day, area,
               avg(CAST(round(price * 100) AS BIGINT)) AS mean_cents, CAST(count(*) AS BIGINT) AS n
        FROM price_facts GROUP BY 1, 2""",
)
def metric_kept(spark, sf):
    """Daily means kept as sums by batch: facts up to a day, those after it, then late ones; the
    second batch is given twice."""
    path = scratch_path(spark, "means")
    cents = V.price_facts(spark, sf).withColumn("cents", F.round(F.col("price") * 100).cast("bigint"))
    late = F.col("cents") % 7 == 0
    early = F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz")
    for number, some in ((0, ~late & early), (1, ~late & ~early), (1, ~late & ~early), (2, late)):
        partials = quality.metric_partials(cents.filter(some), "cents")
        keyedtable.add_up(partials, path, ["period", "area"], ["total", "n"], buckets=16, batch=("facts", number))
    means = quality.means_of_partials(keyedtable.read(spark, path))
    return means.select(
        F.date_format("period", "yyyy-MM-dd").alias("day"), "area", F.col("mean_value").alias("mean_cents"), "n"
    )

"""Quality, audit and plan tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import audit, graph, quality
from sheafline.operators import requirements as R
from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query


@query(
    "metric_join",
    f"""WITH {Q.METRICS}, {Q.criteria('>=', '-inf')}
        SELECT user_id, name, op, threshold AS target, value FROM criteria""",
)
def metric_join(spark, sf):
    goals = V.criteria(spark, sf, "target").withColumn("op", F.coalesce("op", F.lit(">=")))
    return quality.metric_join(
        goals, V.metrics(spark, sf), float("-inf"), ["user_id", "name"]
    ).select("user_id", "name", "op", "target", "value")


@query(
    "evaluate_goals",
    f"""WITH {Q.METRICS}, {Q.criteria('>=', '-inf')}
        SELECT user_id, name, op, threshold AS target,
               NOT ({Q.compared('value', 'op', 'threshold')}) AS goal_remain FROM criteria""",
)
def evaluate_goals(spark, sf):
    goals = quality.evaluate_goals(
        V.criteria(spark, sf, "target"), V.metrics(spark, sf), ["user_id", "name"]
    )
    return goals.select("user_id", "name", "op", "target", "goal_remain")


@query(
    "evaluate_guards",
    f"""WITH {Q.METRICS}, {Q.criteria('<=', 'inf')}
        SELECT user_id, name, op, threshold AS "limit",
               {Q.compared('value', 'op', 'threshold')} AS guard_remain FROM criteria""",
)
def evaluate_guards(spark, sf):
    guards = quality.evaluate_guards(
        V.criteria(spark, sf, "limit"), V.metrics(spark, sf), ["user_id", "name"]
    )
    return guards.select("user_id", "name", "op", "limit", "guard_remain")


@query(
    "metric_pass",
    f"""WITH {Q.METRICS}, specs AS (
          SELECT p_partkey AS spec_id, p_partkey % 150 AS user_id,
            ['events', 'error_rate', 'spend_cents', 'last_kind'][p_partkey % 4 + 1] AS name,
            CASE WHEN p_partkey % 7 <> 0
                 THEN ['<=', '<', '>=', '>', '==', '!='][p_partkey % 6 + 1] END AS op,
            CASE WHEN p_partkey % 4 <> 3 AND p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS tn,
            CASE WHEN p_partkey % 4 = 3 THEN 'click' END AS ts FROM part),
        v AS (SELECT s.*, m.value, m.value_str,
            CASE WHEN (op IS NULL) <> (tn IS NULL AND ts IS NULL)
                 THEN 'comparator and target go together'
                 WHEN op = '!=' THEN 'unknown comparator'
                 WHEN ts IS NOT NULL AND op <> '==' THEN 'text target needs ==' END AS violation
          FROM specs s LEFT JOIN metrics m ON m.user_id = s.user_id AND m.name = s.name)
        SELECT spec_id, name, violation,
          CASE WHEN violation IS NOT NULL OR op IS NULL THEN NULL
               WHEN tn IS NOT NULL THEN {Q.compared('value', 'op', 'tn')}
               ELSE value_str = ts END AS passed FROM v""",
)
def metric_pass(spark, sf):
    return quality.metric_pass(
        V.metric_specs(spark, sf), V.metrics(spark, sf), ["user_id", "name"]
    ).select("spec_id", "name", "violation", "passed")


@query(
    "duplicate_names",
    """SELECT p_brand || ' ' || p_type AS name, CAST(count(*) AS BIGINT) AS n
       FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_names(spark, sf):
    specs = V.table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    return quality.duplicate_names(specs)


@query(
    "coverage_rate",
    """SELECT lang, CAST(count(*) AS BIGINT) AS expected, CAST(count(l.doc_id) AS BIGINT) AS got,
              round(100.0 * count(l.doc_id) / count(*), 6) AS coverage_rate
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
       GROUP BY lang""",
)
def coverage_rate(spark, sf):
    rates = quality.coverage_rate(
        V.table(spark, sf, "labels"), V.table(spark, sf, "documents"), "doc_id", ["lang"]
    )
    return rates.withColumn("coverage_rate", F.round("coverage_rate", 6))


@query(
    "missing_vs_index",
    """SELECT doc_id, lang, source FROM documents
       WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_vs_index(spark, sf):
    expected = V.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return quality.missing_vs_index(expected, V.table(spark, sf, "labels"), "doc_id")


_ANCHORS = Q.to_flat(
    f"array_to_string(regexp_extract_all({Q.no_scripts('html')}, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), ' ')"
)


@query(
    "quality_scores",
    f"""WITH t AS (SELECT page_id, {Q.page_text('html')} AS text,
            length({Q.to_flat(Q.body('html'))}) AS raw, length({_ANCHORS}) AS links FROM pages),
        c AS (SELECT page_id, len({Q.word_list('text')}) AS words, raw, links,
            list_transform({Q.sentence_list('text')}, lambda s: {Q.norm('s')}) AS p FROM t),
        s AS (SELECT page_id, words, len(p) AS chunks,
            1 - len(list_distinct(p)) / len(p) AS dup_share,
            least(links / greatest(raw, 1), 1.0) AS link_share FROM c)
        SELECT page_id, CAST(words AS BIGINT) AS words, CAST(chunks AS BIGINT) AS chunks,
          round(dup_share, 6) AS dup_share, round(link_share, 6) AS link_share,
          round((least(words / 200, 1.0) + (1 - dup_share) + (1 - link_share)) / 3, 6) AS score
        FROM s""",
)
def quality_scores(spark, sf):
    scores = quality.quality_scores(V.pages(spark, sf))
    return scores.select(
        "page_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("words", "chunks")],
        *[F.round(c, 6).alias(c) for c in ("dup_share", "link_share", "score")],
    )


@query(
    "metric_by_period",
    f"""WITH {Q.PRICE_FACTS}
        SELECT strftime(ts, '%Y-%m-%d') AS day, area,
               avg(CAST(round(price * 100) AS BIGINT)) AS mean_cents, CAST(count(*) AS BIGINT) AS n FROM price_facts
        WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1997-01-01' GROUP BY 1, 2""",
)
def metric_by_period(spark, sf):
    """The request of the kind 'mean price per day in an area and time span'.
    Whole cents keep the sum exact in any order."""
    years = V.price_requests(spark, sf).filter("req_id % 8 = 1")
    kept = R.requirement_filter(V.price_facts(spark, sf), years)
    cents = kept.withColumn("cents", F.round(F.col("price") * 100).cast("bigint"))
    means = quality.metric_by_period(cents, "cents")
    return means.select(
        F.date_format("period", "yyyy-MM-dd").alias("day"),
        "area",
        F.col("mean_value").alias("mean_cents"),
        "n",
    )


@query(
    "answers_patch",
    f"""WITH {Q.REQUIREMENTS}
        SELECT req_id,
          CASE WHEN req_id % 4 <> 0 THEN 'answer ' || c_name ELSE time_start END AS time_start,
          time_end,
          CASE WHEN req_id % 4 <> 0 THEN 'answer ' || c_name ELSE area_value END AS area_value
        FROM requirements JOIN customer ON req_id = c_custkey""",
)
def answers_patch(spark, sf):
    return R.answers_patch(V.requirements(spark, sf), V.answers(spark, sf)).select(
        "req_id", "time_start", "time_end", "area_value"
    )


@query(
    "run_status_counts",
    f"""WITH {Q.RUN_AUDIT}
        SELECT run_id, {', '.join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in audit.STATUSES)}
        FROM (SELECT run_id, node_id, arg_max(status, ("at", CASE status WHEN 'unknown' THEN 0
                WHEN 'queued' THEN 1 WHEN 'running' THEN 2 WHEN 'succeeded' THEN 3 ELSE 4 END)) AS status
              FROM run_audit GROUP BY ALL) GROUP BY run_id""",
)
def run_status_counts(spark, sf):
    return audit.run_status_counts(V.run_audit(spark, sf))


@query(
    "latest_status",
    f"""WITH {Q.RUN_AUDIT}
        SELECT run_id, node_id, arg_max(status, ("at", CASE status WHEN 'unknown' THEN 0
                 WHEN 'queued' THEN 1 WHEN 'running' THEN 2 WHEN 'succeeded' THEN 3 ELSE 4 END)) AS status,
               max("at") AS "at",
               min("at") FILTER (status = 'running') AS started_at
        FROM run_audit GROUP BY run_id, node_id""",
)
def latest_status(spark, sf):
    return audit.latest_status(V.run_audit(spark, sf))


@query(
    "start_order",
    f"""WITH {Q.RUN_AUDIT}, s AS (
          SELECT run_id, node_id, min("at") AS started_at FROM run_audit
          WHERE status = 'running' GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at, node_id) AS seq FROM s""",
)
def start_order(spark, sf):
    return audit.start_order(V.run_audit(spark, sf))


@query(
    "goal_prompt_check",
    """WITH p AS (SELECT c_custkey AS goal_id, 'goal ' || c_mktsegment AS d, c_custkey % 5 AS k FROM customer)
       SELECT goal_id, concat_ws('|', CASE WHEN length(d) < 15 THEN 'short description' END,
         CASE WHEN k IN (0, 1) THEN 'no metric' END, CASE WHEN k = 2 THEN 'repeated metric' END,
         CASE WHEN goal_id % 12 IN (0, 11) THEN 'priority' END) AS problems FROM p""",
)
def goal_prompt_check(spark, sf):
    """Goals of the market segments; metrics are absent, none, repeated or different by turn."""
    kind = F.col("c_custkey") % 5
    metrics = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) for n in names])
    prompts = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("goal_id"),
        F.concat(F.lit("  goal "), "c_mktsegment", F.lit(" ")).alias("description"),
        F.when(kind == 1, F.filter(metrics("x"), lambda m: F.lit(False)))
        .when(kind == 2, metrics("coverage", "coverage"))
        .when(kind > 2, metrics("coverage", "errors")).alias("success_metrics"),
        (F.col("c_custkey") % 12).alias("priority"),
    )
    return quality.goal_prompt_check(prompts).select(
        "goal_id", F.array_join("problems", "|").alias("problems")
    )


@query(
    "unknown_refs",
    f"""WITH {Q.STEPS}
        SELECT id, tool_name FROM steps WHERE tool_name NOT IN
          (SELECT 'tool-' || c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def unknown_refs(spark, sf):
    return audit.unknown_refs(V.steps(spark, sf), V.tools(spark, sf)).select("id", "tool_name")


@query(
    "undeclared_inputs",
    f"""WITH {Q.STEPS} SELECT src, dst FROM stray""",
)
def undeclared_inputs(spark, sf):
    return audit.undeclared_inputs(V.steps(spark, sf))


@query(
    "known_refs",
    f"""WITH {Q.STEPS}
        SELECT id, tool_name, c_name AS tool_description
        FROM steps JOIN customer ON tool_name = 'tool-' || c_custkey WHERE c_acctbal >= 0""",
)
def known_refs(spark, sf):
    return audit.known_refs(V.steps(spark, sf), V.tools(spark, sf)).select(
        "id", "tool_name", "tool_description"
    )


@query(
    "edge_table",
    f"""WITH {Q.STEPS} SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM stray""",
)
def edge_table(spark, sf):
    return audit.edge_table(V.steps(spark, sf))


@query(
    "plan_indegree",
    f"""WITH {Q.STEPS}
        SELECT id, CAST(count(DISTINCT src) AS BIGINT) AS indegree
        FROM steps LEFT JOIN (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM stray)
          ON id = dst GROUP BY id""",
)
def plan_indegree(spark, sf):
    return audit.plan_indegree(V.steps(spark, sf)).withColumn(
        "indegree", F.col("indegree").cast("bigint")
    )


@query(
    "dependency_levels",
    f"""WITH RECURSIVE {Q.STEPS},
        walk(id, level) AS (
          SELECT id, 0 FROM steps WHERE line = 1
          UNION SELECT e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.id)
        SELECT id, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY id""",
)
def dependency_levels(spark, sf):
    steps = V.declared_steps(spark, sf)
    return graph.dependency_levels(audit.edge_table(steps), steps).withColumn(
        "level", F.col("level").cast("bigint")
    )

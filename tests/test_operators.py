"""Operators on inline rows: the odd cases, and skewed keys against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import audit, extraction as E, graph, quality, ranking, search, web
from sheafline.operators import requirements as R
from sheafline.operators import tables as T
from sheafline.operators.dedupe import dedupe_exact
from sheafline.plans import views as V
from sheafline.sources import eventlog as L
from sheafline.sources import tables as S


# ---- ranking and search


def skewed(spark, n=3000):
    """A third of all rows under one key."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", rng.randrange(10**6), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, r int, i int").repartition(7)


@pytest.mark.parametrize("n", [1, 4, 1500])
def test_first_n_on_a_hot_key(spark, n):
    rows, df = skewed(spark, 6000)
    want = []
    for key in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))[:n]
    got = ranking.first_n(df, ["k"], [F.col("r"), F.col("i")], n)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_n_trims_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = ranking.first_n(df, ["k"], [F.col("r")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def hits(spark, rows):
    return spark.createDataFrame(rows, "query string, provider_order int, rank int, url string")


def test_first_provider_with_results_wins(spark, rows):
    df = hits(spark, [("q", 1, 1, "a"), ("q", 1, 2, "b"), ("q", 0, 9, "z"), ("p", 2, 1, "c"),
                      ("p", 2, 2, "d"), ("p", 2, 3, "e")])
    got = rows(search.first_nonempty_provider(df, 2).select("query", "url"))
    assert sorted(got) == [("p", "c"), ("p", "d"), ("q", "z")]


@pytest.mark.parametrize("k", [3, 1200])
def test_first_provider_on_a_hot_query(spark, k):
    data = [("hot" if i % 2 else f"q{i % 9}", 1 + i % 3, i, f"u{i}") for i in range(9000)]
    want = set()
    for q in {d[0] for d in data}:
        mine = [d for d in data if d[0] == q]
        first = min(d[1] for d in mine)
        want |= set(sorted((d for d in mine if d[1] == first), key=lambda d: d[2])[:k])
    got = search.first_nonempty_provider(hits(spark, data).repartition(6), k)
    assert {tuple(r) for r in got.collect()} == want


def test_filter_slice_then_dedupe(spark, rows):
    """The order of steps shows: repeats take places, refused urls do not."""
    df = spark.createDataFrame(
        [("q", 1, "no", False), ("q", 2, "a", True), ("q", 3, "a", True), ("q", 4, "b", True)],
        "query string, rank int, url string, allowed boolean",
    )
    assert rows(search.top_k_urls(df, 2).select("url", "rank")) == [("a", 2)]


def test_provider_names():
    assert search.provider_order(" Brave ,, exa") == ["brave", "exa"]
    with pytest.raises(ValueError, match="no search provider"):
        search.provider_order("brave,none")


def test_query_expand_keeps_n_per_topic(spark, rows):
    topics = spark.createDataFrame([("homes",), ("cars",)], "topic string")
    facets = spark.createDataFrame(
        [("region", 2, "Hanoi"), ("format", 1, "download csv"), ("site", 3, "site:gov.vn")],
        "facet_type string, facet_order int, term string",
    )
    got = search.query_expand(topics, facets, 2)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert sorted(r[3] for r in rows(got)) == [
        "cars Hanoi", "cars download csv", "homes Hanoi", "homes download csv",
    ]


# ---- robots


STATUS = [("http://ok", 200), ("http://deny", 403), ("http://gone", 404), ("http://down", 503),
          ("http://dark", None), ("http://moved", 200)]
RULES = [
    ("http://ok", "*", 1, False, "/"),
    ("http://ok", "Bot", 2, True, "/a/b"),
    ("http://ok", "Bot", 3, False, "/a"),
    ("http://ok", "Bot", 4, False, "/q?x=1"),
    ("http://ok", "Bot", 5, False, "/caf%C3%A9"),
    ("http://moved", "*", 1, False, ""),
    ("http://moved", "*", 2, False, "/"),
    ("http://deny", "*", 1, True, "/"),
]
CASES = {
    "http://ok/a/b/c": True,  # first match, not longest
    "http://ok/a/c": False,
    "http://ok/z": True,  # own group: the * group does not apply
    "http://ok/q?x=1&y": False,
    "http://ok/caf%c3%a9/menu": False,
    "http://ok": True,
    "http://moved/x": True,  # empty disallow allows all
    "http://deny/x": False,
    "http://gone/x": True,
    "http://down/x": False,
    "http://dark/x": True,
    "http://unknown/x": True,
}


@pytest.mark.parametrize("limit", [500, 1])
def test_robots_rules(spark, limit):
    urls = spark.createDataFrame([(u,) for u in CASES], "url string")
    status = spark.createDataFrame(STATUS, "origin string, status int")
    rules = spark.createDataFrame(
        RULES, "origin string, agent string, position int, allow boolean, path string"
    )
    got = web.robots_join(urls, status, rules, "MyBot/2.1 (+x)", array_limit=limit)
    assert {r.url: r.allowed for r in got.collect()} == CASES
    allowed = web.robots_allowed(urls, status, rules, "MyBot/2.1", array_limit=limit)
    assert {r.url for r in allowed.collect()} == {u for u, ok in CASES.items() if ok}


def test_robots_at_an_origin_with_very_many_rules(spark):
    """One origin holds most urls and far more rules than the array takes."""
    rng = random.Random(3)
    paths = ["/" + "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(1500)]
    rules = [("http://hot", "*", i, rng.random() < 0.5, p) for i, p in enumerate(paths)]
    rules += [("http://cold", "*", 0, False, "/a")]
    urls = [f"http://hot/{''.join(rng.choice('abc') for _ in range(8))}" for _ in range(800)]
    urls += [f"http://cold/{c}" for c in "abc"]

    def brute(u):
        origin, tail = u[: u.index("/", 7)], u[u.index("/", 7) :]
        for o, _, _, allow, path in rules:
            if o == origin and tail.startswith(path):
                return allow
        return True

    got = web.robots_join(
        spark.createDataFrame([(u,) for u in urls], "url string"),
        spark.createDataFrame([("http://hot", 200), ("http://cold", 200)], "origin string, status int"),
        spark.createDataFrame(
            rules, "origin string, agent string, position int, allow boolean, path string"
        ),
        "x",
        array_limit=20,
    )
    assert sorted((r.url, r.allowed) for r in got.collect()) == sorted((u, brute(u)) for u in urls)


def test_image_rows(spark, rows):
    page = "<img src='/p/a.tar.gz'><img src='b'><img src='.hidden'><img alt=x><img src='c.PNG?v=1.2'>"
    df = spark.createDataFrame([(1, "http://h/d/i", page)], "page_id int, url string, html string")
    got = rows(web.image_manifest(df).select("image_url", "ext"))
    assert got == [("http://h/p/a.tar.gz", ".gz"), ("http://h/d/b", ".jpg"),
                   ("http://h/d/.hidden", ".jpg"), ("http://h/d/c.PNG?v=1.2", ".PNG")]
    assert web.image_manifest(df, 2).count() == 2


def test_external_links(spark, rows):
    page = "<a href='/in'>1</a><a href='http://H.com:80/x'>2</a><a href='http://o.com'>3</a><a href='mailto:a@h.com'>4</a>"
    df = spark.createDataFrame([(1, "http://h.com/", page)], "page_id int, url string, html string")
    got = rows(web.external_link_filter(web.links(df)).select("link"))
    assert got == [("http://h.com/in",), ("http://H.com:80/x",)]


def test_repeated_results_do_not_multiply(spark, rows):
    urls = spark.createDataFrame([("u",), ("u",)], "url string")
    results = spark.createDataFrame([("u", 2), ("u", 1), ("v", 3)], "url string, id int")
    assert rows(web.page_result_join(urls, results, "id")) == [("u", 1), ("u", 1)]


# ---- requirements


def test_gaps_checks_and_answers(spark):
    req = spark.createDataFrame(
        [(1, " \t", None, "X", "e", None, None), (2, "a", "b", "c", "e", "moon", "t")],
        "req_id int, time_start string, time_end string, area_value string, entity_type string, "
        "scope string, topic string",
    )
    one, two = R.requirement_gaps(req).orderBy("req_id").collect()
    assert one.questions == [R.QUESTIONS["time_start"], R.QUESTIONS["time_end"]]
    assert (one.is_complete, two.is_complete) == (False, True)
    one, two = R.requirement_check(req).orderBy("req_id").collect()
    assert (one.scope, one.topic, one.violation) == ("local", "natural", None)
    assert two.violation == "scope:moon;time_start:a;time_end:b"
    answers = spark.createDataFrame(
        [(1, "time_end", "2025"), (1, "area_value", None), (9, "topic", "x")],
        "req_id int, field string, answer string",
    )
    patched = R.answers_patch(req, answers).orderBy("req_id").collect()
    assert [(r.time_end, r.area_value) for r in patched] == [("2025", "X"), ("b", "c")]


def test_requirement_parse_names_unknown_keys(spark):
    df = spark.createDataFrame([('{"topic": "t", "color": 1}',)], "p string")
    row = R.requirement_parse(df, "p").first()
    assert (row.topic, row.unknown_keys) == ("t", ["color"])


# ---- quality


def test_missing_metrics_keep_their_defaults(spark):
    metrics = spark.createDataFrame([("m", 5.0)], "name string, value double")
    criteria = [("m", 5.0, op) for op in ("<=", "<", ">=", ">", "==")]
    criteria += [("none", 1.0, "<="), ("none", 1.0, ">="), ("m", 6.0, None)]
    goals = spark.createDataFrame(criteria, "name string, target double, op string")
    got = {(r.name, r.op, r.target): r.goal_remain for r in quality.evaluate_goals(goals, metrics).collect()}
    assert got == {("m", "<=", 5.0): False, ("m", "<", 5.0): True, ("m", ">=", 5.0): False,
                   ("m", ">", 5.0): True, ("m", "==", 5.0): False, ("none", "<=", 1.0): False,
                   ("none", ">=", 1.0): True, ("m", ">=", 6.0): True}
    guards = goals.withColumnRenamed("target", "limit")
    got = {(r.name, r.op, r.limit): r.guard_remain for r in quality.evaluate_guards(guards, metrics).collect()}
    assert got[("none", "<=", 1.0)] is False and got[("none", ">=", 1.0)] is True
    assert got[("m", "<=", 6.0)] is True  # the default operator


def test_metric_specs(spark):
    specs = spark.createDataFrame(
        [("a", None, None, None), ("a", "<", None, None), ("a", None, 1.0, None),
         ("a", "<", None, "x"), ("a", "!=", 1.0, None), ("s", "==", None, "x"), ("a", "<", 1.0, None)],
        "name string, comparator string, target_num double, target_str string",
    )
    metrics = spark.createDataFrame(
        [("a", 0.5, None), ("s", None, "x")], "name string, value double, value_str string"
    )
    got = [(r.violation, r.passed) for r in quality.metric_pass(specs, metrics).collect()]
    together = ("comparator and target go together", None)
    assert sorted(got, key=str) == sorted(
        [(None, None), together, together, ("text target needs ==", None),
         ("unknown comparator", None), (None, True), (None, True)], key=str)


def test_quality_scores(spark):
    page = "<article><p>One two. One two. Three.</p></article><a href='x'>link</a>"
    df = spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string")
    r = quality.quality_scores(df).first()
    assert (r.words, r.chunks) == (5, 3)
    assert r.dup_share == pytest.approx(1 / 3) and r.link_share == pytest.approx(4 / 29)
    assert r.score == pytest.approx((5 / 200 + 2 / 3 + 25 / 29) / 3)


# ---- extraction


def test_grounding_and_pivot(spark, rows):
    df = spark.createDataFrame(
        [(1, "see a@b.co and c@d.org, call 555-123-4567"), (2, "nothing")], "doc_id int, text string"
    )
    found = E.ground_spans(E.extract_labels(df, V.LABEL_PATTERNS, ["doc_id"]))
    got = {(r.extraction_class, r.extraction_text, r.start, r.end) for r in found.collect()}
    assert got == {("email", "a@b.co", 4, 10), ("email", "c@d.org", 15, 22),
                   ("phone", "555-123-4567", 29, 41)}
    piv = E.pivot_records(found, ["phone", "email", "card"], "doc_id")
    assert rows(piv) == [(1, "555-123-4567", "a@b.co", None)]
    absent = spark.createDataFrame([("t", "x")], "text string, extraction_text string")
    assert E.ground_spans(absent).first().start is None


def test_terms_on_a_hot_word(spark):
    docs = [(i, "the Red fox and the dog " * 3) for i in range(200)]
    terms = [("animal", "fox"), ("animal", "RED fox"), ("article", "the"), ("none", "cat")]
    got = E.extract_terms(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(terms, "label string, value string"),
        ["doc_id"],
    )
    assert got.count() == 600
    assert {r.extraction_text for r in got.collect()} == {"fox", "red fox", "the"}


def test_examples(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [
        ("good", body, [("a", "w1"), ("b", "w2")]),
        ("order", body, [("b", "w2"), ("a", "w1")]),
        ("case", body, [("A", "w1"), ("b", "w2")]),
        ("twice", body, [("a", "w1"), ("b", "w2"), ("b", "w3")]),
        ("off", body, [("a", "nope"), ("b", "w2")]),
        ("short", "w1 w2", [("a", "w1"), ("b", "w2")]),
        ("line", body + "\n", [("a", "w1"), ("b", "w2")]),
    ]
    df = spark.createDataFrame(
        rows, "id string, text string, extractions array<struct<label:string,value:string>>"
    )
    labels = F.array(F.lit("a"), F.lit("b"))
    got = {r.id: r.problems for r in E.example_check(df, labels).collect()}
    assert got == {"good": [], "order": ["label order"],
                   "case": ["extra label", "missing label", "label order"],
                   "twice": ["repeated label", "label order"], "off": ["ungrounded value"],
                   "short": ["length"], "line": ["line break"]}


def test_extractors(spark, rows):
    with pytest.raises(ValueError):
        E.register_extractor(E.Extractor("nothing"))
    with pytest.raises(ValueError):
        E.register_extractor(E.Extractor("no schema", fn=lambda b, s: b))
    with pytest.raises(KeyError):
        E.apply_extractor(spark.range(1), "unknown")
    E.register_extractor(E.Extractor("hooks", post={"twice": F.col("id") * 2}))
    assert rows(E.apply_extractor(spark.range(2), "hooks")) == [(0, 0), (1, 2)]

    def build():
        return {"built": 0}

    def count(batch, state):
        state["built"] += 1
        return batch.assign(batches=state["built"])

    many = E.Extractor("stateful", fn=count, schema="id bigint, batches bigint", setup=build)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    got = E.apply_extractor(spark.range(0, 40, 1, 2), many).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.batches for r in got) == 2  # one state per task, kept across its batches


# ---- tables


FEATURES = [T.Feature("id", "int", "", True), T.Feature("p", "float"), T.Feature("d", "date"),
            T.Feature("o", "money")]


def test_schema_and_description(spark):
    schema = T.schema_from_features(FEATURES)
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "double", "timestamp_ntz", "string"]
    assert T.empty_table(spark, FEATURES).count() == 0
    assert T.primary_key(FEATURES) == ["id"]
    assert T.describe_features(spark, FEATURES).count() == 4
    old = T.Feature.of({"name": "x", "dtype": "int", "description": "why"})
    assert old.evidence == "why"
    with pytest.raises(ValueError):
        T.Feature.of({"name": "x", "dtype": "int", "weight": 1})


def raw(spark):
    return spark.createDataFrame(
        [("1", "2.5", "2024-01-02", "x"), ("2", "bad", "2024-01-02", None), (None, None, "soon", "y")],
        "id string, p string, d string, o string",
    )


def test_casts_and_rejects(spark):
    tried = T.cast_records(raw(spark), FEATURES, "try").collect()
    assert [r.p for r in tried] == [2.5, None, None]
    with pytest.raises(Exception, match="column p is not float: bad"):
        T.cast_records(raw(spark).filter("id = '2'"), FEATURES).collect()
    reasons = [r.reasons for r in T.reject_rows(raw(spark), FEATURES).collect()]
    assert reasons == [["cast:p"], ["null_pk:id", "cast:d"]]
    assert T.accepted_rows(raw(spark), FEATURES).count() == 1
    lacking = raw(spark).drop("o")
    assert all("missing:o" in r.reasons for r in T.reject_rows(lacking, FEATURES).collect())
    with pytest.raises(ValueError):
        T.cast_records(lacking, FEATURES)


def test_strict_cast_does_not_need_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="column . is not "):
            T.cast_records(raw(spark), FEATURES).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_inserts(spark):
    table = T.empty_table(spark, FEATURES)
    rows = raw(spark).filter("id = '1'").withColumn("extra", F.lit("e"))
    assert T.insert_records(table, rows, FEATURES).first().extra == "e"
    with pytest.raises(ValueError, match="undeclared"):
        T.insert_records(table, rows, FEATURES, strict=True)
    with pytest.raises(ValueError, match="missing"):
        T.insert_records(table, rows.drop("p"), FEATURES)


def test_primary_keys(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, t int")
    assert rows(T.pk_violations(df, ["id"])) == [(1, 2)]
    with pytest.raises(ValueError, match="repeated primary key"):
        T.require_unique(df, ["id"])
    newer = spark.createDataFrame([(2, "d", 5)], "id int, v string, t int")
    got = T.upsert_by_pk(df, newer, ["id"], [F.col("t").desc()])
    assert sorted(rows(got)) == [(1, "b", 2), (2, "d", 5)]
    assert T.require_unique(got, ["id"]).count() == 2


def test_fill_column(spark, rows):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    values = spark.createDataFrame([(1, "x"), (2, "y")], "id int, value string")
    assert sorted(rows(T.fill_column(table, "v", values, ["id"]))) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="no such column"):
        T.fill_column(table, "w", values, ["id"])
    for wrong in (values.filter("id = 1"), values.union(spark.createDataFrame([(3, "z")], values.schema))):
        with pytest.raises(Exception, match="exactly one value"):
            T.fill_column(table, "v", wrong, ["id"]).collect()


def test_fill_column_refuses_repeats(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    values = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, value string")
    with pytest.raises(Exception, match="exactly one value"):
        T.fill_column(table, "v", values, ["id"]).select("id").collect()


def test_terms_with_marks_and_any_length(spark):
    docs = spark.createDataFrame([(1, "In London. Then Paris,, (Rome), Oslo! New York City?")], "doc_id int, text string")
    terms = spark.createDataFrame(
        [("city", v) for v in ("London", "paris", "ROME", "Oslo", "New York City", "York Town")],
        "label string, value string",
    )
    got = {r.extraction_text for r in E.extract_terms(docs, terms, ["doc_id"]).collect()}
    assert got == {"london", "paris", "rome", "oslo", "new york city"}


def test_equal_values_keep_their_places(spark):
    text = "110.0.0.1x then 10.0.0.1 and 10.0.0.1"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = E.ground_spans(E.extract_labels(df, {"ip": r"(?<![0-9])[0-9]{2}(?:\.[0-9]{1,3}){3}(?![0-9a-z])"}, ["doc_id"]))
    assert sorted((r.start, r.end) for r in found.collect()) == [(16, 24), (29, 37)]


def test_periods_of_requests(spark):
    facts = spark.createDataFrame(
        [("a", f"{d} 12:00:00") for d in ("2019-12-31", "2020-01-01", "2025-06-01", "2025-12-31", "2026-01-01")]
        + [("b", "2025-06-01 00:00:00")], "area string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    asked = [
        (1, "a", "2020", "2025", "local", 3), (2, "a", "2025-06-01", "2025-06-01", None, 1),
        (3, "a", None, "2025-06", "local", 3), (4, None, " ", "", "global", 6),
        (5, "a", "2026", "soon", "local", 0), (6, "zzz", "2025", None, "global", 4), (7, " ", "2020", None, "local", 0),
    ]
    req = spark.createDataFrame([r[:5] for r in asked], "req_id int, area_value string, time_start string, time_end string, scope string")
    got = {r.req_id: r["count"] for r in R.requirement_filter(facts, req).groupBy("req_id").count().collect()}
    assert got == {r[0]: r[5] for r in asked if r[5]}
    bad = {r.req_id: r.violation for r in R.requirement_check(req.withColumn("topic", F.lit("t"))).collect() if r.violation}
    assert bad == {5: "time_end:soon"}


# ---- dedupe, audit, graph


def test_dedupe_of_a_hot_copy(spark, rows):
    data = [(i, "Same  text\n" if i % 3 == 0 else f"text {i}") for i in range(900)] + [(-1, "same text")]
    df = spark.createDataFrame(data, "id int, text string").repartition(5)
    got = {r[0] for r in rows(dedupe_exact(df, "text", "id"))}
    assert got == {-1} | {i for i in range(900) if i % 3}


def test_audit(spark):
    schema = "plan_id string, branch_id string, run_id string, node_id string, status string, error string, at int"
    df = spark.createDataFrame(
        [("p", None, "r", "n", "running", None, 1), ("p", None, "r", "n", "archived", None, 3),
         ("p", None, "r", "m", "failed", "e", 2)], schema)
    got = audit.run_status_counts(df).first()
    assert (got.running, got.unknown, got.failed, got.queued) == (0, 1, 1, 0)  # a node counts once
    tied = df.union(df.filter("at = 3").withColumn("status", F.lit("running")))
    assert {r.status for r in audit.latest_status(tied).collect()} == {"running", "failed"}
    assert [tuple(r)[1::2] for r in audit.start_order(df).collect()] == [("n", 1)]
    last = {r.node_id: (r.status, r.started_at) for r in audit.latest_status(df).collect()}
    assert last == {"n": ("unknown", 1), "m": ("failed", None)}
    assert audit.audit_rows(df).filter("branch_id = ''").count() == 3


def steps(spark, rows):
    return spark.createDataFrame(rows, "id string, inputs_from array<string>")


def test_levels_and_degrees(spark):
    plan = steps(spark, [("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("d", ["c", "c"]), ("e", []), ("f", None)])
    levels = graph.dependency_levels(audit.edge_table(plan), plan)
    assert {r.id: r.level for r in levels.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "f": 0}
    degrees = {r.id: r.indegree for r in audit.plan_indegree(plan).collect()}
    assert degrees == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0}


@pytest.mark.parametrize("plan", [
    [("a", []), ("b", ["a", "d"]), ("c", ["b"]), ("d", ["c"])],
    [("a", ["a"])],
])
def test_cycles_are_refused(spark, plan):
    with pytest.raises(ValueError, match="cycle"):
        graph.dependency_levels(audit.edge_table(steps(spark, plan)))


def test_levels_of_a_random_graph_with_a_hot_node(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(i), i) for i in range(1, 120) for _ in range(3)}
    edges |= {(0, i) for i in range(1, 120)} | {(i, 200) for i in range(120)}
    want = {0: 0}
    for n in sorted({d for _, d in edges}):
        want[n] = 1 + max(want[s] for s, d in edges if d == n)
    got = graph.dependency_levels(spark.createDataFrame(sorted(edges), "src int, dst int"))
    assert {r.id: r.level for r in got.collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    stored = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or stored(df))
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    # and a way around the first half
    edges = edges.union(spark.range(1).select(F.lit(0).alias("src"), F.lit(n // 2).alias("dst")))
    levels = graph.dependency_levels(edges)
    assert levels.filter("id <> level").isEmpty() and levels.count() == n + 1
    assert len(rounds) < 40


def test_an_error_names_the_cycle(spark):
    edges = [(1, 2), (2, 3), (20, 21), (21, 22), (22, 20), (3, 21), (22, 30), (30, 31), (40, 41), (41, 40)]
    with pytest.raises(ValueError, match="cycle: 20, 21, 22; 40, 41$"):
        graph.dependency_levels(spark.createDataFrame(edges, "src int, dst int"))
    many = [(i, (i + 1) % 50) for i in range(50)]
    with pytest.raises(ValueError, match="cycle: 0, 1, 2, 3, 4, 5, 6, 7, 8, 9 and more$"):
        graph.dependency_levels(spark.createDataFrame(many, "src int, dst int"))


def test_hot_area_is_spread(spark):
    """Facts of one area meet a wide request under many keys."""
    facts = spark.range(20_000).select(
        F.lit("a").alias("area"),
        F.timestamp_micros(F.col("id") * 3_600_000_000).cast("timestamp_ntz").alias("ts"),
    )
    req = spark.createDataFrame([(1, "a", None, None), (2, "a", "1970-02", "1971")], "req_id int, area_value string, time_start string, time_end string")
    got = R.requirement_filter(facts, req)
    assert {r.req_id: r["count"] for r in got.groupBy("req_id").count().collect()} == {1: 20_000, 2: 700 * 24 - 12 * 24 + 11 * 24}
    keys = R.aligned_periods(F.lit(0), F.lit(20_000 // 24))
    assert facts.limit(1).select(F.size(keys).alias("n")).first().n > 13


# ---- event log and sources


def test_ids_follow_the_order(spark):
    data = [(i * 7919 % 1000, "x" if i % 3 else "y") for i in range(1000)]
    df = spark.createDataFrame(data, "n int, v string").repartition(9)
    got = L.assign_ids(df, ["v", "n"], last_id=10).collect()
    want = {r: i for i, r in enumerate(sorted((v, n) for n, v in data), 11)}
    assert {(r.v, r.n): r.id for r in got} == want


def test_empty_batches_and_offsets(spark, rows, tmp_path):
    assert L.assign_ids(spark.range(0), ["id"]).count() == 0
    offsets = spark.createDataFrame([("a", 5)], "consumer string, last_id bigint")
    both = spark.createDataFrame([("a",), ("b",), ("b",)], "consumer string")
    assert sorted(rows(L.ensure_offsets(offsets, both))) == [("a", 5), ("b", 0)]
    assert sorted(rows(L.get_offsets(offsets, both))) == [("a", 5), ("b", 0), ("b", 0)]
    moved = spark.createDataFrame([("a", 2), ("c", 9)], "consumer string, last_id bigint")
    assert rows(L.set_offsets(offsets, moved)) == [("a", 2)]


def test_log_reads_prune_and_push_down(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, "t" if i % 2 else "u") for i in range(20)], "n int, topic string")
    summary = L.event_append(rows, log, None, ["n"])
    assert {r.topic: (r.inserted, r.last_event_id) for r in summary.collect()} == {"t": (10, 20), "u": (10, 19)}
    L.event_append(rows.drop("topic"), log, "t", ["n"], L.last_event_id(spark, log))
    page = L.event_read(L.read_log(spark, log), "t", since_id=18, page=3)
    assert [r.id for r in page.collect()] == [20, 21, 22]
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThan(id,18)" in plan
    assert "TakeOrderedAndProject" in plan


def test_sources(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi", é')], "id bigint, v string")
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / fmt)
        writer = df.write.option("header", True).option("escape", '"')
        writer.format(fmt).save(path)
        source = S.DataSource("local_file", path, {"format": fmt, "header": "true", "escape": '"'})
        assert rows(S.scan_source(spark, source, "id bigint, v string")) == [(1, 'say "hi", é')]
        if fmt != "parquet":
            landed = S.landed_files_scan(spark, path, fmt, "id bigint, v string")
            assert landed.first().source_file.endswith(fmt)
    assert rows(S.scan_source(spark, S.DataSource("api", str(tmp_path / "json")), "id bigint")) == [(1,)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"id": 1}\n{broken\n')
    bad = S.landed_files_scan(spark, str(tmp_path / "bad"), "json", "id bigint")
    assert {(r.id, r._corrupt_record) for r in bad.collect()} == {(1, None), (None, "{broken")}
    with pytest.raises(ValueError):
        S.DataSource("ftp", "x")
    with pytest.raises(ValueError):
        S.scan_source(spark, S.DataSource("local_file", "x.bin"))


def test_table_write_modes(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    S.table_write(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        S.table_write(df, path)
    S.table_write(df, path, "append")
    assert spark.read.parquet(path).count() == 6
    S.table_write(df, path, "replace")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        S.table_write(df, path, "upsert")
    S.json_export(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_small_scans_are_dealt_out(spark, sf):
    docs = V.table(spark, sf, "documents")
    assert S.spread(docs, 7).rdd.getNumPartitions() == 7
    assert S.spread(docs, None) is docs


def test_upsert_paths_agree(spark):
    rng = random.Random(9)
    table = spark.createDataFrame(
        [(i, rng.randrange(5), "t") for i in range(300)] + [(None, 1, "t"), (None, 1, "u")],
        "k int, t int, v string",
    )
    rows = spark.createDataFrame(
        [(rng.choice([7, None, rng.randrange(400)]), rng.randrange(9), f"r{i}") for i in range(200)],
        table.schema,
    )
    order = [F.col("t").desc(), F.col("v")]
    full = T.upsert_by_pk(table, rows, ["k"], order).collect()
    fast = T.upsert_by_pk(table, rows, ["k"], order, table_unique=True).collect()
    assert sorted(map(str, full)) == sorted(map(str, fast))
    keys = [r.k for r in full if r.k is not None]
    assert len(set(keys)) == len(keys)
    loose = rows.filter("k is null").count()
    assert loose > 0 and len(full) - len(keys) == loose + 2


def test_first_n_with_many_partitions_and_large_n(spark):
    rows = [("hot", i * 7919 % 9000) for i in range(9000)]
    df = spark.createDataFrame(rows, "k string, r int").repartition(70)
    got = ranking.first_n(df, ["k"], [F.col("r")], 700)
    assert sorted(r.r for r in got.collect()) == list(range(700))

"""A log with several writers, a stored table by key, and metrics kept in one."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sheafline.operators import quality
from sheafline.sources import keyedtable as K
from sheafline.sources import manifest as M
from sheafline.sources import sharedlog as S
from sheafline.streaming import events as E


@pytest.fixture()
def log(tmp_path):
    return str(tmp_path / "log")


def batch(spark, first, n, topic="t"):
    return spark.range(first, first + n).select(F.lit(topic).alias("topic"), F.col("id").alias("x"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_name_is_published_once(spark, tmp_path):
    path = str(tmp_path / "m" / "a")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda i: M.publish(spark, path, {"by": i}), range(12)))
    assert sum(won) == 1 and M.content(spark, path) == {"by": won.index(True)}
    assert M.published(spark, str(tmp_path / "m")) == ["a"]
    assert M.published(spark, str(tmp_path / "none")) == []


def test_writers_at_once(spark, log):
    with ThreadPoolExecutor(4) as pool:
        ranges = list(pool.map(lambda i: S.append(batch(spark, 1000 * i, 50 + i), log, f"w{i}", ["x"]), range(5)))
    rows = S.read(spark, log).collect()
    assert sorted(r.id for r in rows) == list(range(1, 261))
    assert len({r.payload for r in rows}) == 260
    for i, (low, high) in enumerate(ranges):
        own = sorted((r.id, r.payload) for r in rows if r.topic == f"w{i}")
        assert (own[0][0], own[-1][0]) == (low, high)
        assert [json.loads(p)["x"] for _, p in own] == list(range(1000 * i, 1000 * i + 50 + i))


def test_no_id_appears_behind_one_that_was_read(spark, log):
    S.append(batch(spark, 0, 3), log, None, ["x"])
    number, _ = S._claim(spark, log, 10)  # a writer that is not done
    S.append(batch(spark, 10, 2), log, None, ["x"])
    assert ids(S.read(spark, log)) == [1, 2, 3] and S.open_claims(spark, log) == [number]
    assert S.give_up(spark, log, number) and not S.give_up(spark, log, number)
    assert ids(S.read(spark, log)) == [1, 2, 3, 14, 15] and S.open_claims(spark, log) == []


def test_a_writer_that_was_given_up_fails(spark, log, monkeypatch):
    zones = S._zones

    def late(session, path):
        assert S.give_up(session, log, 0)
        return zones(session, path)

    monkeypatch.setattr(S, "_zones", late)
    with pytest.raises(ValueError, match="given up"):
        S.append(batch(spark, 0, 3), log, None, ["x"])
    assert ids(S.read(spark, log)) == []


def test_a_late_reader_opens_only_the_files_behind_its_id(spark, log):
    for i in range(6):
        S.append(batch(spark, 10 * i, 10, "a" if i % 2 else "b"), log, None, ["x"])
    assert len(S.read(spark, log).inputFiles()) >= 6
    late = S.read(spark, log, since_id=50)
    assert ids(late) == list(range(51, 61)) and all("claim-5" in f for f in late.inputFiles())
    assert all("topic=a" in f for f in S.read(spark, log, "a").inputFiles())
    before = [tuple(r) for r in S.read(spark, log).orderBy("id").collect()]
    assert S.compact(spark, log, file_rows=40)
    S.append(batch(spark, 900, 5, "b"), log, None, ["x"])
    after = S.read(spark, log)
    assert [tuple(r) for r in after.orderBy("id").collect()][:60] == before and after.count() == 65
    assert len(after.inputFiles()) <= 5
    assert len(S.read(spark, log, since_id=60).inputFiles()) == 1
    assert ids(S.read(spark, log, "a", 35)) == [36, 37, 38, 39, 40, *range(51, 61)]
    assert S.compact(spark, log) and S.read(spark, log).count() == 65


def test_log_edges(spark, log):
    assert ids(S.read(spark, log)) == [] and not S.compact(spark, log)
    S.append(batch(spark, 0, 0), log, None, ["x"])
    assert ids(S.read(spark, log)) == []
    S.append(batch(spark, 0, 1), log, None, ["x"])
    assert ids(S.read(spark, log)) == [1] and ids(S.read(spark, log, "zzz")) == []


# ---- stored table


def table(spark, path):
    return sorted((tuple(r) for r in K.read(spark, path).collect()), key=str)


def test_only_buckets_of_the_keys_are_rewritten(spark, log):
    rows = spark.range(500).select("id", F.lit("old").alias("v"), F.lit(1).alias("n"))
    K.upsert(rows, log, ["id"], [F.desc("n")], buckets=16)
    _, before = K.version(spark, log)
    new = spark.createDataFrame([(7, "new", 2), (8, "stale", 0), (1000, "more", 1)], "id long, v string, n int")
    assert K.upsert(new, log, ["id"], [F.desc("n")]) == 1
    _, after = K.version(spark, log)
    met = {str(r[0]) for r in new.select(K.bucket_of(["id"], 16)).distinct().collect()}
    assert {b for b in after["buckets"] if before["buckets"].get(b) != after["buckets"][b]} == met
    held = {r.id: r.v for r in K.read(spark, log).collect()}
    assert len(held) == 501 and (held[7], held[8], held[1000]) == ("new", "old", "more")


def test_a_crash_before_the_swap_changes_nothing(spark, log, monkeypatch):
    first = spark.createDataFrame([(1, "a", 1)], "id int, v string, n int")
    K.upsert(first, log, ["id"], [F.desc("n")])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(M, "publish", broken)
        with pytest.raises(OSError, match="lost"):
            K.upsert(first.withColumn("n", F.lit(2)), log, ["id"], [F.desc("n")])
    assert table(spark, log) == [(1, "a", 1)]
    K.upsert(first.withColumn("n", F.lit(3)), log, ["id"], [F.desc("n")])
    assert table(spark, log) == [(1, "a", 3)]


def test_updates_at_once_lose_nothing(spark, log):
    K.add_up(spark.createDataFrame([("k", 0)], "k string, n long"), log, ["k"], ["n"], buckets=4)
    rows = spark.createDataFrame([("k", 1), ("j", 2)], "k string, n long")
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda _: K.add_up(rows, log, ["k"], ["n"]), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and table(spark, log) == [("j", 8), ("k", 4)]


def test_table_edges(spark, log):
    with pytest.raises(ValueError, match="no table"):
        K.read(spark, log)
    none = spark.createDataFrame([], "id int, v string")
    K.upsert(none, log, ["id"], [F.desc("v")])
    assert table(spark, log) == []
    rows = spark.createDataFrame([(None, "a"), (None, "b"), (1, "x"), (1, "y")], "id int, v string")
    K.upsert(rows, log, ["id"], [F.desc("v")])
    K.upsert(rows.limit(1), log, ["id"], [F.desc("v")])
    assert [r for r in table(spark, log) if r[0]] == [(1, "y")]
    assert sum(r[0] is None for r in table(spark, log)) == 3


# ---- metrics


def test_kept_means_equal_recomputed_ones_after_each_batch(spark, tmp_path):
    path, source = str(tmp_path / "means"), str(tmp_path / "in")
    schema = "ts timestamp_ntz, area string, v long"
    days = [f"2024-01-0{1 + i % 4} 1{i % 9}:00:00" for i in range(40)]
    facts = spark.createDataFrame(
        [(d, "ab"[i % 2], i if i % 7 else None) for i, d in enumerate(days)], "ts string, area string, v long"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # the last batch holds the earliest day only
    parts = [facts.filter("v % 3 = 0"), facts.filter("v % 3 = 1"), facts.filter("v % 3 = 2 or v is null")]
    seen = None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        seen = part if seen is None else seen.unionByName(part)
        stream = E.file_stream(spark, source, schema)
        E.keep_metric(stream, path, str(tmp_path / "check"), "v").awaitTermination()
        got = quality.means_of_partials(K.read(spark, path)).filter("n > 0")
        want = quality.metric_by_period(seen, "v").filter("n > 0")
        columns = ["period", "area", "mean_value", "n"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_polling_on_a_clock(spark, log, tmp_path):
    """A pipe that polls picks up what comes later, until it is stopped."""
    import time

    source = str(tmp_path / "in")
    batch(spark, 0, 5).write.mode("append").parquet(source)
    stream = E.file_stream(spark, source, "topic string, x long")
    pipe = E.event_pipe(stream, log, str(tmp_path / "check"), ["x"], trigger={"processingTime": "150 milliseconds"})

    def arrived(n):
        end = time.time() + 60
        while time.time() < end:
            if M.published(spark, log + "_heads") and E.pipe_summary(spark, log).agg(F.sum("inserted")).first()[0] == n:
                return True
            time.sleep(0.2)
        return False

    try:
        assert arrived(5)
        batch(spark, 50, 3).write.mode("append").parquet(source)
        assert arrived(8) and pipe.isActive
    finally:
        pipe.stop()

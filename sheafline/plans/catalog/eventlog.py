"""The event log, batch half, and consumer offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.plans import fragments as Q
from sheafline.plans import views as V
from sheafline.plans.registry import query
from sheafline.session import scratch_path
from sheafline.sources import eventlog as L
from sheafline.sources import sharedlog


@query(
    "event_append",
    """SELECT row_number() OVER (ORDER BY event_id) AS id, 'harvest' AS topic,
         CAST(json_object('event_id', event_id, 'user_id', user_id, 'kind', event_type || ' é')
              AS VARCHAR) AS payload FROM events""",
)
def event_append(spark, sf):
    """Two appends; the second goes on from the first one's last id."""
    path = scratch_path(spark, "log")
    rows = V.table(spark, sf, "events").select(
        "event_id", "user_id", F.concat("event_type", F.lit(" é")).alias("kind")
    )
    cutoff = rows.agg((F.max("event_id") / 2).cast("bigint").alias("c")).scalar()
    L.event_append(rows.filter(F.col("event_id") <= cutoff), path, "harvest", ["event_id"])
    last = L.last_event_id(spark, path)
    L.event_append(rows.filter(F.col("event_id") > cutoff), path, "harvest", ["event_id"], last)
    return L.read_log(spark, path).select("id", "topic", "payload")


@query(
    "assign_ids",
    """SELECT event_id, user_id, 1000 + row_number() OVER (ORDER BY user_id, event_id) AS id
       FROM events""",
)
def assign_ids(spark, sf):
    batch = V.table(spark, sf, "events").select("event_id", "user_id")
    return L.assign_ids(batch, ["user_id", "event_id"], last_id=1000)


@query(
    "event_read",
    f"""WITH {Q.EVENT_LOG}
        SELECT id, payload FROM event_log WHERE topic = 'click' AND id > 500
        ORDER BY id LIMIT 256""",
)
def event_read(spark, sf):
    return L.event_read(V.event_log(spark, sf), "click", since_id=500)


@query(
    "event_read_all",
    f"""WITH {Q.EVENT_LOG}
        SELECT id, payload FROM event_log WHERE topic = 'click' AND id > 500""",
)
def event_read_all(spark, sf):
    return L.event_read(V.event_log(spark, sf), "click", since_id=500, page=None)


@query(
    "page_limit",
    f"""WITH {Q.EVENT_LOG}
        SELECT id, topic, payload FROM event_log ORDER BY id LIMIT 256""",
)
def page_limit(spark, sf):
    return L.page_limit(V.event_log(spark, sf).select("id", "topic", "payload"))


@query(
    "event_summary",
    f"""WITH {Q.EVENT_LOG}
        SELECT topic, CAST(count(*) AS BIGINT) AS inserted, max(id) AS last_event_id
        FROM event_log GROUP BY topic""",
)
def event_summary(spark, sf):
    return L.event_summary(V.event_log(spark, sf))


@query(
    "resume_join",
    f"""WITH {Q.EVENT_LOG}, {Q.OFFSETS}
        SELECT r.consumer, e.topic, e.id, e.payload FROM event_log e
        JOIN readers r ON r.topic = e.topic
        LEFT JOIN consumer_offsets o ON o.consumer = r.consumer
        WHERE e.id > coalesce(o.last_id, 0)""",
)
def resume_join(spark, sf):
    due = L.resume_join(
        V.event_log(spark, sf), V.readers(spark, sf), V.consumer_offsets(spark, sf)
    )
    return due.select("consumer", "topic", "id", "payload")


@query(
    "resume",
    f"""WITH {Q.EVENT_LOG}, {Q.OFFSETS}
        SELECT id, payload FROM event_log WHERE topic = 'error' AND id >
          (SELECT last_id FROM consumer_offsets WHERE consumer = 'reader_error')""",
)
def resume(spark, sf):
    return L.resume(
        V.event_log(spark, sf), "reader_error", "error", V.consumer_offsets(spark, sf), page=None
    )


def _user_offsets(spark, sf):
    """Everyone; offsets of those whose last event was no error, at that event;
    updates back to the first event of those who clicked or viewed last, or
    have no offset."""
    users = (
        V.table(spark, sf, "events")
        .groupBy(F.concat(F.lit("c"), "user_id").alias("consumer"))
        .agg(
            F.max_by("event_type", "event_id").alias("kind"),
            F.max("event_id").alias("hi"),
            F.min("event_id").alias("lo"),
        )
    )
    stored = users.filter("kind <> 'error'").select("consumer", F.col("hi").alias("last_id"))
    moved = users.filter("kind in ('click', 'view', 'error')").select(
        "consumer", F.col("lo").alias("last_id")
    )
    return users.select("consumer"), stored, moved


_USERS = """u AS (SELECT 'c' || user_id AS consumer, max(event_id) AS hi, min(event_id) AS lo,
                    arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)"""


@query(
    "ensure_offsets",
    f"WITH {_USERS} SELECT consumer, CASE WHEN kind <> 'error' THEN hi ELSE 0 END AS last_id FROM u",
)
def ensure_offsets(spark, sf):
    everyone, stored, _ = _user_offsets(spark, sf)
    return L.ensure_offsets(stored, everyone)


@query(
    "get_offsets",
    f"WITH {_USERS} SELECT consumer, CASE WHEN kind <> 'error' THEN hi ELSE 0 END AS last_id FROM u",
)
def get_offsets(spark, sf):
    everyone, stored, _ = _user_offsets(spark, sf)
    return L.get_offsets(stored, everyone)


@query(
    "set_offsets",
    f"""WITH {_USERS} SELECT consumer, CASE WHEN kind IN ('click', 'view') THEN lo ELSE hi END AS last_id
        FROM u WHERE kind <> 'error'""",
)
def set_offsets(spark, sf):
    _, stored, moved = _user_offsets(spark, sf)
    return L.set_offsets(stored, moved)


def _shared_log(spark, sf):
    """Odd events, then a claim that is given up, then even ones by topic, compacted half way."""
    log = scratch_path(spark, "shared")
    events = V.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    odd = events.filter("event_id % 2 = 1").select("event_id", "user_id")
    sharedlog.append(odd, log, "odd", ["event_id"])
    number, _ = sharedlog._claim(spark, log, 100)
    sharedlog.give_up(spark, log, number)
    sharedlog.compact(spark, log)
    even = events.filter("event_id % 2 = 0").withColumn("topic", F.col("event_type"))
    sharedlog.append(even.select("topic", "event_id"), log, None, ["event_id"])
    return log


_SHARED_SQL = """
    rows AS (
      SELECT row_number() OVER (ORDER BY event_id) AS id, 'odd' AS topic,
             CAST(json_object('event_id', event_id, 'user_id', user_id) AS VARCHAR) AS payload
      FROM events WHERE event_id % 2 = 1
      UNION ALL
      SELECT row_number() OVER (ORDER BY event_id) + 100
               + (SELECT count(*) FROM events WHERE event_id % 2 = 1), event_type,
             CAST(json_object('event_id', event_id) AS VARCHAR)
      FROM events WHERE event_id % 2 = 0)"""


@query("shared_append", f"WITH {_SHARED_SQL} SELECT CAST(id AS BIGINT) AS id, topic, payload FROM rows")
def shared_append(spark, sf):
    """The log of ``_shared_log``, all of it."""
    return sharedlog.read(spark, _shared_log(spark, sf)).select("id", "topic", "payload")


@query(
    "shared_read_since",
    f"""WITH {_SHARED_SQL}
        SELECT CAST(id AS BIGINT) AS id, payload FROM rows
        WHERE topic = 'view' AND id > (SELECT max(id) - 500 FROM rows)""",
)
def shared_read_since(spark, sf):
    """A late reader of one topic: the last 500 ids, from the files that hold them."""
    log = _shared_log(spark, sf)
    last = sharedlog.read(spark, log).agg(F.max("id")).first()[0]
    return sharedlog.read(spark, log, "view", last - 500).select("id", "payload")

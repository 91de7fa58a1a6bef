"""The request: completeness, allowed values, answers, and what it selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sheafline.functions.text import strip

# The fields of a request, and the scopes it can have.
FIELDS = (
    "time_start", "time_end", "area_value", "entity_type", "scope", "additional_details", "topic",
)

# The question asked for each missing field, in this order.
QUESTIONS = {
    "time_start": "Provide the start of the time span.",
    "time_end": "Provide the end of the time span.",
    "area_value": "Provide the explicit area name (e.g. 'Ho Chi Minh City').",
}
SCOPES = ("global", "local")

REQUIREMENT_SCHEMA = (
    "time_start string, time_end string, area_value string, entity_type string, "
    "scope string, additional_details array<string>, topic string"
)


def query_list(queries: Column) -> Column:
    """Query strings of the sub-prompts, in order."""
    return F.transform(queries, lambda q: q["query"])


def feature_names(features: Column) -> Column:
    """Feature names, in order."""
    return F.transform(features, lambda f: f["name"])


def requirement_gaps(req: DataFrame) -> DataFrame:
    """Add ``questions`` for blank fields and ``is_complete``."""
    asked = [
        F.when(F.col(f).isNull() | (strip(F.col(f)) == ""), F.lit(q)) for f, q in QUESTIONS.items()
    ]
    return req.withColumn("questions", F.array_compact(F.array(*asked))).withColumn(
        "is_complete", F.size("questions") == 0
    )


def requirement_check(req: DataFrame) -> DataFrame:
    """Fill defaults (scope ``local``, topic ``natural``) and add ``violation``.

    A ``scope`` outside the allowed set is a violation, and so are a time that
    cannot be read and any name in ``unknown_keys``, where the row has that column.
    """
    reasons = [
        F.when(~F.col("scope").isin(*SCOPES), F.concat(F.lit("scope:"), F.col("scope"))),
        *(
            F.when(
                ~_blank(F.col(f)) & period_bounds(F.col(f))["start"].isNull(),
                F.concat(F.lit(f"{f}:"), F.col(f)),
            )
            for f in ("time_start", "time_end")
            if f in req.columns
        ),
    ]
    if "unknown_keys" in req.columns:
        reasons.append(
            F.when(
                F.size("unknown_keys") > 0,
                F.concat(F.lit("unknown:"), F.array_join("unknown_keys", ",")),
            )
        )
    return (
        req.withColumn("scope", F.coalesce("scope", F.lit("local")))
        .withColumn("topic", F.coalesce("topic", F.lit("natural")))
        .withColumn("violation", F.nullif(F.concat_ws(";", *reasons), F.lit("")))
    )


def requirement_parse(df: DataFrame, payload: str) -> DataFrame:
    """Requirement columns of a JSON text, with keys that do not belong."""
    keys = F.json_object_keys(F.col(payload))
    known = F.array(*[F.lit(f) for f in FIELDS])
    return (
        df.withColumn("_r", F.from_json(payload, REQUIREMENT_SCHEMA))
        .withColumn("unknown_keys", F.array_except(keys, known))
        .select(*df.columns, "_r.*", "unknown_keys")
    )


def answers_patch(req: DataFrame, answers: DataFrame, key: str = "req_id") -> DataFrame:
    """Requirements with non-null answers (``field``, ``answer``) written over.

    Answers fold to one row per request first. Two answers to one field: the
    greater text wins, so that the result does not depend on row order.
    """
    fields = [f for f in FIELDS if f in req.columns and f != "additional_details"]
    folded = answers.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, F.col("answer"))).alias(f"_{f}") for f in fields]
    )
    patched = req.join(folded, key, "left")
    return patched.select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c)
            for c in req.columns
        ]
    )


def _blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def period_bounds(text: Column) -> Column:
    """{start, end} of the period that a time names: a year, a month, a day, or
    with a clock time that instant. ``end`` is the start of what follows."""
    t = strip(text)
    day = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(
        t.rlike(r"^\d{4}-\d{1,2}$"), F.concat(t, F.lit("-01"))
    ).otherwise(t)
    start = day.try_cast("timestamp_ntz")
    end = (
        F.when(t.rlike(r"^\d{4}$"), start + F.expr("interval 1 year"))
        .when(t.rlike(r"^\d{4}-\d{1,2}$"), start + F.expr("interval 1 month"))
        .when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), start + F.expr("interval 1 day"))
        .otherwise(start + F.expr("interval 1 microsecond"))
    )
    return F.struct(start.alias("start"), end.alias("end"))


#: Days of the aligned periods that spans are cut into. The largest is short, so that a key holds the
#: facts of one area in two months at most.
PERIODS = (64, 8, 1)


def aligned_periods(first: Column, last: Column, sizes: tuple[int, ...] = PERIODS) -> Column:
    """{_size, _at} of the aligned periods that make up the days ``first`` to ``last``, largest first where they
    fit: period ``_at`` of a size holds the days from _at * _size on. None if the span is empty."""
    size, rest = sizes[0], sizes[1:]
    none = F.array().cast("array<struct<_size:int,_at:int>>")
    low = F.floor((first + size - 1) / size).cast("int")
    high = F.floor((last + 1) / size).cast("int")
    own = F.transform(
        F.sequence(low, high - 1), lambda x: F.struct(F.lit(size).alias("_size"), x.alias("_at"))
    )
    fits = low < high
    made = F.when(fits, own).otherwise(none)
    if not rest:
        return made
    before = aligned_periods(first, F.when(fits, low * size - 1).otherwise(last), rest)
    after = aligned_periods(F.when(fits, high * size).otherwise(last + 1), last, rest)
    return F.concat(made, before, after)


def requirement_filter(facts: DataFrame, req: DataFrame) -> DataFrame:
    """Facts (``area``, ``ts``) inside the area and the time span of each request.

    Both bounds count in full: a span up to a year holds all of that year. A
    null or blank bound is open; one that cannot be read selects nothing, as
    ``requirement_check`` reports it. Scope ``global`` has no area test; any other does, and
    a blank area then selects nothing. A fact without a time is in no span.

    A request meets its facts by area (all of them, if global) and aligned period: its span, cut to
    the days of the facts, is parted into few disjoint periods, and a fact lies in one of
    each size. So facts of one area or year are spread over many keys, and only those of the
    first and last day are looked at in vain.
    """
    scope = F.coalesce("scope", F.lit("local")) if "scope" in req.columns else F.lit("local")
    readable = lambda f: _blank(F.col(f)) | period_bounds(F.col(f))["start"].isNotNull()
    day = lambda ts: F.unix_date(ts.cast("date"))
    days = facts.agg(F.struct(F.min(day(F.col("ts"))).alias("lo"), F.max(day(F.col("ts"))).alias("hi")))
    spans = (
        req.filter(readable("time_start") & readable("time_end"))
        .select(
            "req_id",
            (scope == "global").alias("_all"),
            F.when(scope == "global", F.lit("")).otherwise(F.col("area_value")).alias("_area"),
            F.when(~_blank(F.col("time_start")), period_bounds(F.col("time_start"))["start"]).alias("_from"),
            F.when(~_blank(F.col("time_end")), period_bounds(F.col("time_end"))["end"]).alias("_to"),
            days.scalar().alias("_days"),
        )
        .withColumns(
            {
                "_first": F.greatest(day(F.col("_from")), F.col("_days.lo")),
                "_last": F.least(day(F.col("_to") - F.expr("interval 1 microsecond")), F.col("_days.hi")),
            }
        )
        .filter("_first <= _last")
    )
    periods = spans.select(
        "req_id", "_all", "_area", "_from", "_to", F.inline(aligned_periods(F.col("_first"), F.col("_last")))
    )
    # which of these keys a fact needs: few, whatever the requests
    kinds = periods.agg(F.collect_set(F.struct("_all", "_size")).alias("kinds"))
    keyed = facts.filter("ts is not null").withColumn("_kind", F.explode(kinds.scalar()))
    keyed = keyed.withColumns(
        {
            "_all": F.col("_kind._all"),
            "_area": F.when(F.col("_kind._all"), F.lit("")).otherwise(F.col("area")),
            "_size": F.col("_kind._size"),
            "_at": F.floor(day(F.col("ts")) / F.col("_kind._size")).cast("int"),
        }
    )
    inside = F.coalesce(F.col("ts") >= F.col("_from"), F.lit(True)) & F.coalesce(
        F.col("ts") < F.col("_to"), F.lit(True)
    )
    met = keyed.join(periods, ["_all", "_area", "_size", "_at"]).filter(inside)
    return met.select(*facts.columns, "req_id")

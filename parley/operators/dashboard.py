"""Dashboard aggregates over meetings. The as-of time is a parameter, so results do not depend on the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scalar import average_label
from parley.sources.model import READ_DEFAULTS


def newest(meetings: DataFrame, n: int | None = None) -> DataFrame:
    """Active meetings, newest first."""
    d = meetings.filter("deleted_at IS NULL").orderBy(F.desc("uploaded_at"), F.desc("id"))
    return d.limit(n) if n else d


def trash(meetings: DataFrame) -> DataFrame:
    """Deleted meetings, last deleted first."""
    return meetings.filter("deleted_at IS NOT NULL").orderBy(F.desc("deleted_at"), F.desc("id"))


def point(meetings: DataFrame, key: int | str) -> DataFrame:
    """One active meeting."""
    return meetings.filter((F.col("id") == key) & F.col("deleted_at").isNull())


def with_defaults(meetings: DataFrame) -> DataFrame:
    """Columns that a reader fills in, filled in."""
    return meetings.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in READ_DEFAULTS.items() if c in meetings.columns})


def by_status(meetings: DataFrame) -> DataFrame:
    """Totals by status, one row."""
    return meetings.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Completed").alias("completed"), F.count_if(F.col("status") == "Processing").alias("processing"), F.count_if(F.col("status") == "Failed").alias("failed"))


def in_range(meetings: DataFrame, kind: str, as_of: str, day: str | None = None) -> DataFrame:
    """Meetings of the last 7 or 30 days, this month or one day; those without a date pass every filter."""
    ts, now = F.col("uploaded_at"), F.lit(as_of).cast("timestamp")
    tests = {
        "7d": (now.cast("double") - ts.cast("double")) / 86_400 <= 7, "30d": (now.cast("double") - ts.cast("double")) / 86_400 <= 30,
        "month": F.date_trunc("month", ts) == F.date_trunc("month", now), "day": F.to_date(ts) == F.to_date(F.lit(day)), "all": F.lit(True),
    }
    return meetings.filter(ts.isNull() | tests[kind])


def facets(meetings: DataFrame, status: str | None = None, meeting_type: str | None = None, department: str | None = None) -> DataFrame:
    """Meetings that match every given facet, whatever the case, with readers' defaults for missing values."""
    d = meetings
    for column, value in (("status", status), ("meeting_type", meeting_type), ("department", department)):
        if value:
            d = d.filter(F.lower(F.coalesce(F.col(column), F.lit(READ_DEFAULTS.get(column, "")))) == value.lower())
    return d


def category_share(meetings: DataFrame) -> DataFrame:
    """Client meetings against all others, in whole percent."""
    kind = F.when(F.lower(F.coalesce("meeting_type", F.lit(""))) == "client", "client").otherwise("internal")
    d = meetings.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))
    return d.withColumn("pct", F.floor(100 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5).cast("int"))  # two rows at most


def top_departments(meetings: DataFrame, n: int = 5) -> DataFrame:
    """The departments with most meetings and their width against the first."""
    d = meetings.groupBy(F.coalesce("department", F.lit(READ_DEFAULTS["department"])).alias("department")).agg(F.count("*").alias("n"))
    top = d.orderBy(F.desc("n"), "department").limit(n)
    return top.withColumn("width", F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy()), 1))


def daily_uploads(meetings: DataFrame, as_of: str, days: int = 7, missing_is_today: bool = False) -> DataFrame:
    """Uploads for each of the last days, zero where there are none."""
    today = F.to_date(F.lit(as_of))
    spark = meetings.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    date = F.to_date("uploaded_at")
    date = F.coalesce(date, today) if missing_is_today else date
    counts = meetings.filter(date.between(F.date_sub(today, days - 1), today)).groupBy(date.alias("day")).agg(F.count("*").alias("n"))
    joined = spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), (F.col("day") == today).alias("is_today"))
    most = F.max("n").over(Window.partitionBy())  # `days` rows
    return joined.withColumn("bar", F.when(F.col("n") > 0, F.greatest(F.round(100.0 * F.col("n") / most, 1), F.lit(14.0))).otherwise(F.lit(0.0)))


def durations(meetings: DataFrame) -> DataFrame:
    """Minutes in all and the mean duration, as number and label."""
    d = meetings.agg(F.round(F.sum("duration_seconds") / 60).cast("bigint").alias("minutes"), F.round(F.avg("duration_seconds")).alias("mean_seconds"))
    return d.withColumn("mean_label", average_label(F.col("mean_seconds")))


def longest(meetings: DataFrame, n: int = 10) -> DataFrame:
    """The longest meetings, a missing duration as 0."""
    return meetings.orderBy(F.desc(F.coalesce("duration_seconds", F.lit(0.0))), "id").limit(n)


def page(meetings: DataFrame, number: int, size: int = 8) -> DataFrame:
    """One page of the newest-first list, counted from 1."""
    return newest(meetings).offset((number - 1) * size).limit(size)


def pages(meetings: DataFrame, size: int = 8) -> DataFrame:
    """How many pages there are; at least one."""
    return meetings.filter("deleted_at IS NULL").agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias("pages"))


def notifications(meetings: DataFrame, n: int = 5) -> DataFrame:
    """The newest meetings still in processing."""
    return newest(meetings.filter("status = 'Processing'"), n)


def across_meetings(shares: DataFrame) -> DataFrame:
    """Talk time by name over all meetings, with the first colour and each share's arc offset."""
    by = shares.groupBy("name").agg(F.sum("ms").alias("ms"), F.min_by("color", F.struct("meeting_id", "rank")).alias("color")).filter("ms > 0")
    # people in order of time over ranges of it: offsets inside a range, plus those of the ranges before
    total = by.agg(F.sum("ms").alias("total"))  # one row
    ranked = by.withColumn("band", F.floor(F.log2(F.greatest("ms", F.lit(1e-9)))).cast("int"))
    bands = ranked.groupBy("band").agg(F.sum("ms").alias("band_ms"))  # a row for each power of two
    above = bands.select("band", F.coalesce(F.sum("band_ms").over(Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("above"))
    inside = Window.partitionBy("band").orderBy(F.desc("ms"), "name").rowsBetween(Window.unboundedPreceding, -1)
    d = ranked.join(F.broadcast(above), "band").crossJoin(F.broadcast(total)).withColumn("before", F.col("above") + F.coalesce(F.sum("ms").over(inside), F.lit(0.0)))
    return d.select("name", "ms", "color", F.round(F.col("before") / F.col("total"), 6).alias("arc_start"), F.round(F.col("ms") / F.col("total"), 6).alias("share"))


def flatten_tasks(meetings: DataFrame, strict: bool = False) -> DataFrame:
    """Tasks of a meeting from its four sources, the first of each text.

    Sources, in order: action_items(title, assignee, due), pending(topic, description, owner), commitments
    (action, owner, timing), deadlines(detail, deadline); arrays of structs of strings. `strict` reads only
    the keys title, assignee and due, which the later sources do not have.
    """
    plain = lambda src, title, who, due: F.transform(F.coalesce(F.col(src), F.array()), lambda x: F.struct(F.lit(src).alias("source"), title(x).alias("title"), who(x).alias("assignee"), due(x).alias("due")))
    none = lambda x: F.lit(None).cast("string")
    sources = [plain("action_items", lambda x: x["title"], lambda x: x["assignee"], lambda x: x["due"])]
    if not strict:
        sources += [
            plain("pending", lambda x: F.coalesce(x["description"], x["topic"]), lambda x: x["owner"], none),
            plain("commitments", lambda x: x["action"], lambda x: x["owner"], lambda x: x["timing"]),
            plain("deadlines", lambda x: x["detail"], none, lambda x: x["deadline"]),
        ]
    d = meetings.select("id", F.posexplode(F.concat(*sources)).alias("pos", "t")).select("id", "pos", "t.*").filter("title IS NOT NULL AND trim(title) <> ''")
    # within the first source every task counts; later ones only if their text is new
    seen = F.row_number().over(Window.partitionBy("id", "title").orderBy("pos"))
    d = d.withColumn("seen", seen).filter((F.col("seen") == 1) | (F.col("source") == "action_items"))
    return d.select("id", "pos", "source", "title", F.coalesce("assignee", F.lit("Unassigned")).alias("assignee"), F.coalesce("due", F.lit("Not specified")).alias("due"))


def task_totals(tasks: DataFrame) -> DataFrame:
    """Tasks of each meeting: all, and those with an owner."""
    return tasks.groupBy("id").agg(F.count("*").alias("tasks"), F.count_if(F.col("assignee") != "Unassigned").alias("assigned"))


def task_list(meetings: DataFrame, tasks: DataFrame) -> DataFrame:
    """Meetings with tasks if there are any, else all."""
    some = tasks.agg((F.count("*") > 0).alias("some"))  # one row
    marked = meetings.join(tasks.select("id", F.lit(True).alias("has")).distinct(), "id", "left").crossJoin(F.broadcast(some))
    return marked.filter(F.col("has") | ~F.col("some")).drop("has", "some")

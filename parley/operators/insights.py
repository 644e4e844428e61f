"""Decisions and actions that a model proposed, checked against what was said; insights from what survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.functions import vocabulary as V
from parley.operators.quotes import quote_matches


def overlap_ratio(quote: Column, line: Column) -> Column:
    """The share of a quote's tokens that a line has."""
    q = F.array_distinct(X.tokens(quote))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.tokens(line))) / F.size(q)).otherwise(F.lit(0.0))


def is_decision(text: Column) -> Column:
    """Neither hypothetical nor filler, and not a single word unless a telling one."""
    low = F.btrim(F.lower(F.trim(text)), F.lit(" .,!?"))
    maybe = X.cue(low, V.HYPOTHETICAL) | low.isin(V.FILLER_DECISIONS)
    short = (F.size(F.split(F.trim(text), r"\s+")) < 2) & ~X.cue(low, V.SHORT_DECISIONS)
    return (F.trim(text) != "") & ~maybe & ~short


def is_action(text: Column) -> Column:
    """No question, no fragment, no opening that asks."""
    low = F.btrim(F.lower(F.trim(text)), F.lit(" .,!?"))
    asks = F.lit(False)
    for start in V.NO_ACTION_STARTS:
        asks = asks | low.startswith(start)
    return (F.trim(text) != "") & ~F.trim(text).endswith("?") & ~low.isin(V.NO_ACTIONS) & ~asks


def first_by_key(rows: DataFrame, key: Column, order: str, group: str = "meeting_id") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(group, "_key").orderBy(order)
    return rows.withColumn("_key", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_key", "_r")


def verify_assignee(raw: Column, names: Column, spoken: Column) -> Column:
    """A proposed owner if known by name, or if it occurs in what was said and has three characters; else null."""
    who = F.btrim(F.coalesce(raw, F.lit("")))
    known = F.exists(names, lambda n: X.normalise(n) == X.normalise(who))
    return F.when(F.lower(who).isin(V.NO_OWNER), None).when(known, who).when((F.length(who) >= 3) & F.contains(F.lower(spoken), F.lower(who)), who)


def colors(lines: DataFrame) -> DataFrame:
    """The first colour of each display name."""
    name = X.normalise(F.coalesce("speaker", "speaker_label"))
    return lines.groupBy("meeting_id", name.alias("name")).agg(F.min_by("color", "position").alias("color"))


def collect_decisions(proposed: DataFrame, lines: DataFrame) -> DataFrame:
    """Decisions (meeting_id, item, text, quote) that hold: filtered, verified if they quote, first of each text."""
    d = proposed.filter(is_decision(F.col("text")))
    checked = quote_matches(d.select("meeting_id", "item", "quote"), lines).drop("quote")
    d = d.join(checked, ["meeting_id", "item"], "left")
    d = d.filter((F.trim(F.coalesce("quote", F.lit(""))) == "") | F.col("verified"))
    d = first_by_key(d, X.normalise(F.col("text")), "item")
    src = lines.select("meeting_id", F.col("position").alias("source_position"), F.col("text").alias("line"), F.col("start_ms").alias("source_ms"))
    return d.join(src, ["meeting_id", "source_position"], "left").select("meeting_id", "item", "text", F.coalesce("line", F.nullif(F.trim("quote"), F.lit("")), "text").alias("quote"), "source_ms")


def collect_actions(proposed: DataFrame, lines: DataFrame) -> DataFrame:
    """Actions (meeting_id, item, title, owner, due, quote) that hold, with owners resolved and coloured."""
    d = proposed.filter(is_action(F.col("title")))
    checked = quote_matches(d.select("meeting_id", "item", "quote"), lines).drop("quote")
    d = d.join(checked, ["meeting_id", "item"], "left").filter((F.trim(F.coalesce("quote", F.lit(""))) == "") | F.col("verified"))
    src = lines.select("meeting_id", F.col("position").alias("source_position"), F.col("text").alias("line"), F.coalesce("speaker", "speaker_label").alias("sayer"), F.col("start_ms").alias("source_ms"))
    spoken = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])  # in order, for names that a line border cuts
    known = lines.groupBy("meeting_id").agg(F.array_sort(F.collect_set(F.coalesce("speaker", "speaker_label"))).alias("names"), F.array_join(spoken, " ").alias("spoken"))
    d = d.join(src, ["meeting_id", "source_position"], "left").join(known, "meeting_id", "left")
    own = F.lower(F.trim(F.coalesce("owner", F.lit(""))))
    who = F.when(own.isin(V.FIRST_PERSON) & F.col("sayer").isNotNull(), F.col("sayer")).otherwise(verify_assignee(F.col("owner"), F.coalesce("names", F.array().cast("array<string>")), F.coalesce("spoken", F.lit(""))))
    d = d.withColumn("assignee", who).withColumn("due", X.nullish(F.col("due")))
    d = first_by_key(d, X.normalise(F.concat("title", F.lit(":"), F.coalesce("assignee", F.lit("None")))), "item")
    c = colors(lines).withColumnRenamed("name", "owner_key")
    d = d.withColumn("owner_key", X.normalise(F.col("assignee"))).join(c, ["meeting_id", "owner_key"], "left")
    return d.select("meeting_id", "item", "title", "assignee", "due", "color", F.coalesce("line", F.nullif(F.trim("quote"), F.lit("")), "title").alias("quote"), "source_ms")


def insights(actions: DataFrame) -> DataFrame:
    """Per meeting: commitments (8), deadlines (4), pending (5) and unowned items (4), each of the first actions by title."""
    d = first_by_key(actions.filter("trim(title) <> ''"), X.normalise(F.col("title")), "item")
    owner, due = F.coalesce("assignee", F.lit("Unassigned")), F.coalesce("due", F.lit("Not specified"))
    row = F.struct("item", F.col("title").alias("title"), owner.alias("owner"), due.alias("due"))
    d = d.groupBy("meeting_id").agg(F.array_sort(F.collect_list(row)).alias("xs"))
    free = F.filter("xs", lambda x: x["owner"] == "Unassigned")
    held = F.filter("xs", lambda x: x["owner"] != "Unassigned")
    dated = F.filter("xs", lambda x: ~F.lower(x["due"]).isin(V.NULLISH))
    return d.select(
        "meeting_id",
        F.slice(F.transform("xs", lambda x: F.struct(x["owner"].alias("owner"), x["title"].alias("action"), x["due"].alias("timing"))), 1, 8).alias("commitments"),
        F.slice(F.transform(dated, lambda x: F.struct(x["due"].alias("deadline"), x["title"].alias("detail"))), 1, 4).alias("deadlines"),
        F.slice(F.transform(held, lambda x: F.struct(F.array_join(F.slice(F.split(x["title"], r"\s+"), 1, 4), " ").alias("topic"), x["title"].alias("description"), x["owner"].alias("owner"), F.lit("Pending").alias("status"))), 1, 5).alias("pending"),
        F.slice(F.transform(free, lambda x: F.struct(F.lit("yellow").alias("severity"), F.concat(x["title"], F.lit(" — unassigned task")).alias("text"))), 1, 4).alias("attention_needed"),
    )


def kept_and_dropped(proposed: DataFrame, kept: DataFrame) -> DataFrame:
    """Proposed, kept and dropped items of each meeting."""
    a = proposed.groupBy("meeting_id").agg(F.count("*").alias("proposed"))
    b = kept.groupBy("meeting_id").agg(F.count("*").alias("kept"))
    return a.join(b, "meeting_id", "left").select("meeting_id", "proposed", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("proposed") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def ordered_union(rows: DataFrame, order: str, items: str) -> DataFrame:
    """Lists of several windows joined in order, each item once."""
    d = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct(order, items))).alias("xs"))
    return d.select("meeting_id", F.array_distinct(F.flatten(F.transform("xs", lambda x: x[items]))).alias(items))


def display_insight(pending: Column, commitment: Column) -> tuple[Column, Column]:
    """What a card shows of a pending item and of a commitment."""
    a = F.struct(F.coalesce(pending["description"], pending["topic"]).alias("text"), F.coalesce(pending["status"], F.lit("Pending")).alias("status"))
    b = F.struct(commitment["action"].alias("text"), F.coalesce(commitment["timing"], F.lit("No deadline")).alias("timing"))
    return a, b

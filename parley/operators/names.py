"""Names from what people say: introductions, greetings, repairs of turns that greetings show to be mislabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as X
from parley.functions import vocabulary as V
from parley.helpers import with_fold


def introductions(lines: DataFrame) -> DataFrame:
    """The first name by which each generic label introduces itself."""
    d = lines.withColumn("name", X.introduced_name(F.col("text"))).filter(F.col("name").isNotNull() & X.is_generic(F.col("speaker_label")))
    return d.groupBy("meeting_id", "speaker_label").agg(F.min_by("name", "position").alias("name"))


def first_greetings(lines: DataFrame) -> DataFrame:
    """Whom each label greets first."""
    d = lines.withColumn("greeted", X.greeted_name(F.col("text"))).filter("greeted IS NOT NULL")
    return d.groupBy("meeting_id", "speaker_label").agg(F.min("position").alias("at"), F.min_by("greeted", "position").alias("greeted"))


def mutual_greetings(lines: DataFrame) -> DataFrame:
    """Names of labels that greet one another by name: each is whom the other greets. Pairs count in order of first greeting and overwrite nothing."""
    first = first_greetings(lines)
    each = first.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("speaker_label").alias("label"), "greeted"))).alias("gs"))
    pairs = "flatten(transform(gs, (a, i) -> transform(slice(gs, i + 2, greatest(size(gs) - i - 1, 0)), b -> named_struct('la', a.label, 'lb', b.label, 'na', b.greeted, 'nb', a.greeted))))"
    fold = f"""aggregate({pairs}, cast(map() as map<string,string>), (m, p) -> if(p.na = p.nb, m,
      case when not map_contains_key(m, p.la) and not map_contains_key(m, p.lb) then map_concat(m, map(p.la, p.na, p.lb, p.nb))
        when try_element_at(m, p.la) = p.na and not map_contains_key(m, p.lb) then map_concat(m, map(p.lb, p.nb))
        when try_element_at(m, p.lb) = p.nb and not map_contains_key(m, p.la) then map_concat(m, map(p.la, p.na)) else m end))"""
    return each.select("meeting_id", F.explode(F.expr(fold)).alias("speaker_label", "name"))


def greeting_repairs(lines: DataFrame, within_ms: int = 20_000) -> DataFrame:
    """Lines that answer a greeting under the greeter's own label: the addressee said them.

    A greeting opens a claim for its addressee; the next line of the same label within within_ms, if it bears
    another name, is theirs and closes the claim; another label or a longer gap closes it too.
    """

    def step(z, start, end, label, speaker, greeted):
        who, of, ended = z
        if greeted is not None:
            return (greeted, label, end), None
        if who is None:
            return z, None
        if label != of or start - ended > within_ms:
            return (None, None, 0), None
        if (speaker or "").lower() != who.lower():
            return (None, None, 0), who
        return (who, of, end), None

    d = lines.select("meeting_id", "position", "start_ms", "end_ms", "speaker_label", "speaker", X.greeted_name(F.col("text")).alias("greeted"))
    d = with_fold(d, "meeting_id", ["start_ms", "position"], ["start_ms", "end_ms", "speaker_label", "speaker", "greeted"], (None, None, 0), step, "new_speaker", T.StringType())
    return d.filter("new_speaker IS NOT NULL").select("meeting_id", "position", "new_speaker")


def repair(lines: DataFrame, passes: int = 5) -> DataFrame:
    """greeting_repairs applied until nothing changes, `passes` times at most; each pass is written, so plans stay short."""
    from parley.session import materialise

    d = lines
    for _ in range(passes):
        changes = materialise(greeting_repairs(d), "greeting-repairs")
        if changes.isEmpty():
            break
        d = materialise(d.join(changes, ["meeting_id", "position"], "left").withColumn("speaker", F.coalesce("new_speaker", "speaker")).drop("new_speaker"), "repaired-lines")
    return d


def needs_repair(lines: DataFrame, within_ms: int = 20_000) -> DataFrame:
    """Meetings with a generic speaker, with a greeting that its own speaker seems to answer, or that greet somebody who never speaks.

    A greeting is answered so if a later line, begun within within_ms of its end, bears the same label or the same name
    and another name than the one greeted. Greetings meet such lines by label or name and by stretch of time.
    """
    greeted = F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), V.PLAIN_GREETING, 1))
    who = F.coalesce(F.nullif("speaker_label", F.lit("")), F.nullif("speaker", F.lit("")))
    d = lines.select("meeting_id", "position", "start_ms", "end_ms", F.lower(F.coalesce("speaker", F.lit(""))).alias("name"), who.alias("who"), greeted.alias("greeted"), X.is_generic(F.col("speaker")).alias("generic"))
    keys = F.explode(F.array(F.struct(F.lit(0).alias("by"), F.coalesce("who", F.lit("")).alias("key")), F.struct(F.lit(1).alias("by"), F.col("name").alias("key"))))
    bucket = lambda at: F.floor(at / within_ms)
    until = F.coalesce("end_ms", "start_ms") + within_ms
    said = d.filter("greeted <> ''").select("meeting_id", F.col("position").alias("p"), F.col("start_ms").alias("s"), until.alias("until"), "greeted", keys.alias("k"))
    said = said.select("*", F.explode(F.sequence(bucket(F.col("s")), bucket(F.greatest("until", "s")))).alias("bucket"))
    answers = d.filter("name <> ''").select("meeting_id", "position", "start_ms", "name", bucket(F.col("start_ms")).alias("bucket"), keys.alias("k"))
    later = (F.col("start_ms") > F.col("s")) | ((F.col("start_ms") == F.col("s")) & (F.col("position") > F.col("p")))
    own = said.join(answers, ["meeting_id", "bucket", "k"]).filter(later & (F.col("start_ms") <= F.col("until")) & (F.col("name") != F.col("greeted")))
    absent = d.filter("greeted <> ''").select("meeting_id", F.col("greeted").alias("name")).distinct().join(d.select("meeting_id", "name").distinct(), ["meeting_id", "name"], "left_anti")
    wrong = own.select("meeting_id").unionAll(absent.select("meeting_id")).distinct().withColumn("wrong", F.lit(True))
    each = d.groupBy("meeting_id").agg(F.bool_or("generic").alias("generic"))
    return each.join(wrong, "meeting_id", "left").select("meeting_id", (F.col("generic") | F.coalesce("wrong", F.lit(False))).alias("needs_repair"))


def first_claims(*sources: DataFrame) -> DataFrame:
    """Names claimed for labels (meeting_id, speaker_label, name) by several sources: the earliest source wins a label."""
    d = None
    for i, s in enumerate(sources):
        tagged = s.select("meeting_id", "speaker_label", "name", F.lit(i).alias("source"))
        d = tagged if d is None else d.unionAll(tagged)
    w = Window.partitionBy("meeting_id", "speaker_label").orderBy("source", "name")
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def resolve(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Labels replaced by names (meeting_id, speaker_label, name), in the speaker column and element-wise in candidate lists."""
    each = names.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker_label", "name"))).alias("names"))
    d = lines.join(each, "meeting_id", "left")
    named = lambda x: F.coalesce(F.try_element_at("names", x), x)
    own = F.when(X.is_generic(F.col("speaker")), named(F.col("speaker_label"))).otherwise(F.col("speaker"))
    return d.withColumns({"speaker": F.when(F.col("names").isNull(), F.col("speaker")).otherwise(own), "candidate_speakers": F.when(F.col("names").isNull(), F.col("candidate_speakers")).otherwise(F.transform("candidate_speakers", named))}).drop("names")


def rename_suggestions(profiles: DataFrame, current: str) -> DataFrame:
    """Enrolled names other than the current one."""
    return enrolled_names(profiles).filter(F.lower("name") != current.lower()).orderBy("name")


def enrolled_names(profiles: DataFrame) -> DataFrame:
    """Names with a stored voice, sorted."""
    return profiles.select("name").distinct().orderBy("name")


def with_display_names(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """lines with display (names of stats (meeting_id, label, name) in place of labels or other spellings) and speakers, each shown name once."""
    keyed = stats.select("meeting_id", F.explode(F.array("label", "name")).alias("k"), "name", F.col("position").alias("at")).filter("k IS NOT NULL AND name IS NOT NULL")
    first = keyed.groupBy("meeting_id", F.lower("k").alias("k")).agg(F.min_by("name", "at").alias("name"))
    known = first.groupBy("meeting_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "name"))).alias("known"))
    d = lines.join(known, "meeting_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    raw = F.when(F.size(F.coalesce("candidate_speakers", F.array().cast("array<string>"))) > 0, F.col("candidate_speakers")).otherwise(X.split_composite(F.col("speaker")))
    shown = F.filter(F.transform(raw, lambda x: X.display_of(x, F.col("known"))), lambda x: x != "")
    first_of = F.filter(shown, lambda x, i: F.size(F.filter(F.slice(shown, F.lit(1), i), lambda y: F.lower(y) == F.lower(x))) == 0)
    own = X.display_of(F.col("speaker"), F.col("known"))
    return d.withColumns({"display": own, "speakers": F.when(F.size(first_of) > 0, first_of).otherwise(F.array(own))}).drop("known")


def valid_segments(lines: DataFrame, color: str = "#3b82f6") -> DataFrame:
    """Lines that a player can show: with a speaker or a label, in order of start, with a colour."""
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.nullif("speaker_label", F.lit("")))
    return lines.filter(who.isNotNull()).select("meeting_id", "position", "start_ms", "end_ms", who.alias("speaker"), F.coalesce(F.nullif("color", F.lit("")), F.lit(color)).alias("color")).orderBy("meeting_id", "start_ms", "position")


def roster(members: DataFrame, own: DataFrame) -> DataFrame:
    """Members with one's own row first, in place of any of the same id: columns of members plus position."""
    w = Window.partitionBy("team").orderBy("mine", "position")
    both = own.withColumns({"mine": F.lit(0), "position": F.lit(0)}).unionByName(members.join(own.select("team", "id"), ["team", "id"], "left_anti").withColumn("mine", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("position", F.row_number().over(w) - 1).drop("mine")


def with_vectors(lines: DataFrame, vectors: DataFrame, common_prefix: bool = False) -> DataFrame:
    """Transcript lines with the vectors of the same ordinal (meeting_id, position, embedding); meetings whose numbers differ are left out, or cut to what both have."""
    n = lines.groupBy("meeting_id").agg(F.count("*").alias("n")).join(vectors.groupBy("meeting_id").agg(F.count("*").alias("m")), "meeting_id")
    fit = n if common_prefix else n.filter("n = m")
    return lines.join(vectors, ["meeting_id", "position"]).join(fit.select("meeting_id"), "meeting_id", "left_semi")

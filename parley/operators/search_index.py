"""A search index as posting lists of trigrams and tokens, and search through it.

A text is listed under each of its tokens and under each run of three characters, lower-cased, so a needle inside an
inflected word is found too. Texts lie in stores, partitioned by meeting, sorted by text and numbered; a list holds, for
each block of BLOCK neighbours with the term, a mask of those that have it, so that like texts share an entry and equal
texts are taken apart once a block. The lists
lie in a table that is partitioned by a bucket of the term and sorted by term within its files; so do the terms'
frequencies. A needle reads its own terms' buckets alone, intersects its rarest lists, and the candidates are checked
against the needle itself. Rows are thus the same as without the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as X
from parley.operators.search import search

#: Lists that are intersected for a needle: its rarest ones.
RAREST = 3
#: Rows of a store that share a list's entry: the bits of a long, 2 to the power SHIFT.
SHIFT, BLOCK = 6, 64
AT = ("store", "part", "block")
LINE_STORE = ("meeting_id", "position", "speaker", "language", "text")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased; shorter texts have none."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))."), F.lit(1)))


def terms(text: Column) -> Column:
    """What a text is listed under: its tokens, marked t, and its trigrams, marked g."""
    mark = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.concat(mark("t", F.array_distinct(X.words(text))), mark("g", trigrams(text)))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bit_of(row: Column) -> Column:
    """The place of a numbered row in its block."""
    return row.bitwiseAND(F.lit(BLOCK - 1)).cast("int")


class SearchIndex:
    """The tables of an index at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, meetings: DataFrame, lines: DataFrame, path: str, buckets: int = 64, spread: int = 4) -> SearchIndex:
        """Write the index of meetings (title, agenda) and lines (text); the path must not exist.

        The stores come first and are what the lists are made from, so a row's number is the written one. A bucket's lists
        are written by `spread` tasks, dealt by block, so that a term that a third of all lines hold is no one task's.
        """
        index = cls(lines.sparkSession, path, buckets)
        texts = {"lines": ["text"], "meetings": ["title", "agenda"]}
        listed = []
        for name, rows, key in (("lines", lines.select(*LINE_STORE), "meeting_id"), ("meetings", meetings, "id")):
            kept = rows.withColumn("part", bucket_of(F.col(key), buckets)).repartition("part", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(spread)))
            kept.sortWithinPartitions("part", *texts[name]).withColumn("row", F.monotonically_increasing_id()).write.partitionBy("part").parquet(f"{index.path}/{name}")
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_of(F.col("row")))
            listed.append(index._read(name).select(F.lit(name).alias("store"), "part", F.shiftright("row", SHIFT).alias("block"), mask.alias("rows"), F.array(*texts[name]).alias("texts")))
        # both groupings keep to the partitions by block: terms are not shuffled before a block's have met
        # a stated number, as Spark would join partitions by the size of the texts, of which terms make many times more
        n_parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
        own = listed[0].unionByName(listed[1]).repartition(n_parts, *AT).select(*AT, "rows", F.explode("texts").alias("text"))
        apart = own.groupBy(*AT, "text").agg(F.bit_or("rows").alias("rows")).select(*AT, "rows", F.explode(terms(F.col("text"))).alias("term"))
        both = apart.groupBy("term", *AT).agg(F.bit_or("rows").alias("rows")).withColumn("bucket", bucket_of(F.col("term"), buckets))
        dealt = both.repartition("bucket", F.pmod(F.xxhash64("part", "block"), F.lit(spread)))
        dealt.sortWithinPartitions("bucket", "term", "store", "block").write.partitionBy("bucket").parquet(f"{index.path}/postings")
        n = index._read("postings").groupBy("bucket", "term").agg(F.sum(F.bit_count("rows")).alias("n"))
        n.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{index.path}/frequencies")
        return index

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _lists(self, table: str, wanted: list[str]) -> DataFrame:
        """The rows of some terms; only their buckets are read, and there only row groups that may hold them."""
        own = self.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), bucket_of(F.lit(t), self.buckets).alias("bucket")) for t in wanted])).alias("x"))
        buckets = sorted({r["x"]["bucket"] for r in own.collect()})  # a few terms of one needle
        return self._read(table).filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))

    def rarest(self, wanted: list[str]) -> list[str] | None:
        """Those of a needle's terms with the shortest lists, RAREST of them; None if a term is nowhere."""
        found = {r["term"]: r["n"] for r in self._lists("frequencies", wanted).select("term", "n").collect()}  # a row for each term of the needle
        return None if len(found) < len(wanted) else sorted(found, key=lambda t: (found[t], t))[:RAREST]

    def candidates(self, needle: str, tokens: bool = True) -> DataFrame | None:
        """(store, part, block, rows): masks of the rows that may match a needle, at least of all that do; None where the needle is too short to tell.

        Tokens of a meeting's title and agenda count together, as they are searched.
        """
        needle = needle.strip().lower()
        if len(needle) < 3:
            return None
        words = self.spark.range(1).select(X.words(F.lit(needle)).alias("w")).first()["w"] if tokens else []
        wanted = [sorted({f"g{needle[i : i + 3]}" for i in range(len(needle) - 2)})] + ([sorted({f"t{w}" for w in words})] if words else [])
        found = self._read("postings").select(*AT, "rows").limit(0)
        for group in wanted:
            lists = self.rarest(group)
            if lists:
                hits = self._lists("postings", lists).groupBy(*AT).agg(F.bit_and("rows").alias("rows"), F.count("*").alias("n"))
                found = found.unionByName(hits.filter((F.col("n") == len(lists)) & (F.col("rows") != 0)).select(*AT, "rows"))
        return found.groupBy(*AT).agg(F.bit_or("rows").alias("rows"))

    def _held(self, name: str, rows: DataFrame, held: DataFrame, how: str = "left_semi") -> DataFrame:
        """Those rows of a store that the candidates hold, or with left_anti the others."""
        own = held.filter(F.col("store") == name).select(F.col("part").alias("own_part"), F.col("block").alias("own_block"), F.col("rows").alias("own_rows"))
        same = (F.col("part") == F.col("own_part")) & (F.shiftright("row", SHIFT) == F.col("own_block"))
        return rows.join(own, same & (F.bit_get("own_rows", bit_of(F.col("row"))) == 1), how)

    def search(self, needle: str | None, limit: int = 50, snippets: int = 5, tokens: bool = True) -> DataFrame:
        """What search() gives over the indexed meetings and lines, from the candidates alone.

        A needle of one or two characters has no trigram: it is searched in all lines, as in any trigram index.
        """
        meetings, lines = self._read("meetings"), self._read("lines")
        held = self.candidates(needle, tokens) if (needle or "").strip() else None
        if held is not None:
            # partitions without a candidate are pruned at run time wherever the candidates are small enough to broadcast
            lines = self._held("lines", lines, held)
            spoken = meetings.join(lines.select("part", F.col("meeting_id").alias("id")).distinct(), ["part", "id"], "left_semi")
            meetings = self._held("meetings", meetings, held).unionByName(self._held("meetings", spoken, held, "left_anti"))
        return search(meetings.drop("part", "row"), lines.drop("part", "row"), needle, limit, snippets, tokens)

"""The corpus pipeline over `documents`: five stages, each on all rows that the one before kept.

Every stage but the last returns the columns of documents. run() writes each stage's result to the shared
folder and reads it back, so no stage recomputes the ones before it and lost executors cost one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontamination, language_id, piece_sampling, simhash, substring_dedup
from parley.llm.common import fresh
from parley.llm.queries import MODEL
from parley.session import materialise

#: A text is rejected if it has no letter or its language's share of the scores is below this many times chance, one over the languages learnt.
LEAST_OVER_CHANCE = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: drops documents without a letter (null and empty texts too) or with no language that stands out.

    Null ids and languages do no harm; repeated rows share their fate; an empty table stays empty; any columns pass.
    """
    model = language_id.fit(language_id.learning_rows(docs))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = language_id.classify(docs, model, lang_out=lang, score_out=score)
    least = LEAST_OVER_CHANCE / len(model.languages) if model else 0.0
    return found.filter((F.col(lang) != language_id.UND) & (F.col(score) >= least)).select([F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: keeps one document of each group, by the smallest id, then text; documents without an id come last.

    Null and blank texts are one group; of repeated rows one stays; an empty table stays empty; any columns pass.
    """
    return simhash.keep_one(docs, shingle=4, distance=4)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: texts lose words in 20-word windows that start earlier; other texts, null ones too, stay as they are.

    n_chars, if there is one, follows the text. Documents without an id come before all others. Rows of one id keep what
    its first keeps; an empty table stays empty; any columns pass.
    """
    text, words, removed = (fresh(docs, x) for x in ("kept_text", "n_words", "n_removed"))
    kept = substring_dedup.remove_repeats(docs, window=20, names=(text, words, removed))
    changed = F.col(removed) > 0
    new = {"text": F.col(text), "n_chars": F.length(text)}
    return kept.select([F.when(changed, new[c]).otherwise(F.col(c)).cast(kind).alias(c) if c in new else F.col(f"`{c}`") for c, kind in docs.dtypes])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: drops documents of which at least 5 % are words of benchmark windows.

    Documents are told apart by id and text, so rows of one id, or of none, do not share their fate; null texts stay;
    repeated rows go or stay together; an empty table stays empty; any columns pass.
    """
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (decontamination.text_digest(docs["text"]) == bad["bad_digest"])
    return docs.join(bad, same, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the piece ids of two distinct sampled segmentations of every text, with scores and the round trip's outcome.

    A null or empty text has one row without ids; a null id draws as 0; repeated rows draw alike; an empty table stays empty.
    """
    return piece_sampling.sample_segmentations(docs, MODEL, k=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the kernel model nor XXH64 fingerprints nor the sampling; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

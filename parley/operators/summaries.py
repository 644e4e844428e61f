"""Summaries by map and reduce: a model reads each window, and the parts of a meeting once more if there are several."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Makes the model in each Python worker, once: a function from a numpy array of prompts to as many answers ("" for none).
MakeModel = Callable[[], Callable]


def answers(prompt: Column, make_model: MakeModel, batch: int = 64) -> Column:
    """A model's answer to each prompt; null prompts are not asked, empty answers are null."""
    ask = predict_batch_udf(make_model, return_type=T.StringType(), batch_size=batch)
    return F.when(prompt.isNotNull(), F.nullif(ask(F.coalesce(prompt, F.lit(""))), F.lit("")))


def map_reduce(windows: DataFrame, make_model: MakeModel, merge_model: MakeModel | None = None, batch: int = 64) -> DataFrame:
    """Summaries of meetings from windows (meeting_id, summary_window, content): meeting_id, summary, parts.

    The model reads every window; windows without an answer drop out. One part is the summary. Several are merged by
    merge_model (the same model by default); where that has no answer they are joined by blanks. No part: null.
    """
    asked = windows.select("meeting_id", "summary_window", answers(F.col("content"), make_model, batch).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("summary_window", "part")))), lambda x: x["part"])
    d = asked.groupBy("meeting_id").agg(ordered.alias("xs"))
    several = F.when(F.size("xs") > 1, F.array_join("xs", "\n\n"))
    d = d.withColumn("merged", answers(several, merge_model or make_model, batch))
    summary = F.coalesce("merged", F.nullif(F.array_join("xs", " "), F.lit("")))
    return d.select("meeting_id", summary.alias("summary"), F.size("xs").alias("parts"))

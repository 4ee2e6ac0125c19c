"""Votes of annotators on items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_votes(df: DataFrame, item: str, annotator: str, when: str, row_id: str, practice: Column, answers: dict[str, Column]) -> DataFrame:
    """item, annotator and one column per field: each annotator's latest row per item.

    Rows with a null item or a null or blank annotator are ignored, practice rows too; of equal
    times the larger id counts; an answer that is not valid is null.
    """
    fields = [a.alias(f"f_{n}") for n, a in answers.items()]
    rows = df.filter(~F.coalesce(practice, F.lit(False))).select(F.col(item).alias("item"), F.trim(F.col(annotator)).alias("annotator"), F.col(when).alias("_at"), F.col(row_id).alias("_id"), *fields)
    rows = rows.filter("item is not null and annotator is not null and annotator <> ''")
    last = rows.groupBy("item", "annotator").agg(F.max(F.struct("_at", "_id", *[f"f_{n}" for n in answers])).alias("_last"))
    return last.select("item", "annotator", *[F.col(f"_last.f_{n}").alias(n) for n in answers])

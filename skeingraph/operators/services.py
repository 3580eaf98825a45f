"""Points where a caller puts a model of its own: completion, judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring

#: From a list of prompts to a list of replies; runs in the workers, batch by batch.
Complete = Callable[[list[str]], list[str]]
#: From recalled rows to the same rows with ``verdict``.
Judge = Callable[[DataFrame], DataFrame]


def completed(rows: DataFrame, prompt_col: str, complete: Complete, batch: int = 16) -> DataFrame:
    """``rows`` with ``reply``: what ``complete`` says to each prompt; null where its batch failed."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            replies: list[str | None] = []
            prompts = part[prompt_col].tolist()
            for at in range(0, len(prompts), batch):
                try:
                    replies += complete(prompts[at : at + batch])
                except Exception:  # a service may fail; the rows stay
                    replies += [None] * len(prompts[at : at + batch])
            yield part.assign(reply=replies)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, reply string")


def summary_prompts(members: DataFrame) -> DataFrame:
    """(community_id, prompt) from the members of each community in their order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", F.format_string("[%s] %s: %s", "type", "name", F.coalesce("description", F.lit(""))).alias("line")))), lambda x: x["line"])
    return members.groupBy("community_id").agg(F.array_join(lines, "\n").alias("prompt"))


_judges: dict[str, Judge] = {"heuristic": scoring.judge}


def register_judge(name: str, judge: Judge) -> None:
    _judges[name] = judge


def model_judge(complete: Complete, most: int = 10) -> Judge:
    """A judge that asks a model about the first ``most`` nodes of a feedback; the others, and all where it fails, go by the heuristic."""
    def judge(recalled: DataFrame) -> DataFrame:
        prompt = F.concat_ws("\n", F.lit("Was this used in the reply? used or unused."), "name", "reply")
        plain = scoring.judge(recalled).withColumnRenamed("verdict", "plain").withColumn("__prompt", F.when(F.col("place") <= most, prompt))
        asked = completed(plain.where("__prompt is not null").withColumnRenamed("reply", "answer_text"), "__prompt", complete)
        said = asked.withColumn("verdict", F.when(F.col("reply").isin("used", "unused"), F.col("reply")).otherwise(F.col("plain"))).drop("reply").withColumnRenamed("answer_text", "reply")
        rest = plain.where("__prompt is null").withColumn("verdict", F.col("plain"))
        return said.unionByName(rest).drop("plain", "__prompt")

    return judge


def judge(recalled: DataFrame, strategy: str = "heuristic") -> DataFrame:
    """Verdicts by a registered judge; an unknown name is the heuristic."""
    return _judges.get(strategy, scoring.judge)(recalled)

"""Answers from retrieved passages: context, prompt, completion provider, confidence, response row.

A generator is a function from a DataFrame with `prompt` and `texts` to the same with `reply` (null where it failed),
`finished`, `error`, `model_used` and `generation_time`. GENERATORS holds those known by name.

Defined results: no passages give an empty context; a failed call gives an error text with confidence 0; the confidence
of a reply follows its length, the number of passages and their relevances (a missing one counts as 1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import answer_prompt, context_block, is_korean
from ragloom.operators.ensembles import confidence

Generator = Callable[[DataFrame], DataFrame]

# Texts of error rows.
ERROR_TEXT = {"en": "Sorry, an error occurred while generating the response: ", "kr": "죄송합니다. 응답을 생성하는 중 오류가 발생했습니다: "}


def extractive(df: DataFrame) -> DataFrame:
    """Needs no model: the text of the best passage; fails where there is none."""
    first = F.try_element_at("texts", F.lit(1))
    return df.withColumns({
        "reply": first, "finished": F.lit(True), "error": F.when(first.isNull(), "no passages"), "model_used": F.lit("extractive"), "generation_time": F.lit(0.0)})


GENERATORS: dict[str, Generator] = {"extractive": extractive}


def register(name: str, generator: Generator) -> None:
    GENERATORS[name] = generator


def error_text(language: Column, message: Column) -> Column:
    return F.concat(F.when(is_korean(language), ERROR_TEXT["kr"]).otherwise(ERROR_TEXT["en"]), F.coalesce(message, F.lit("")))


def generate(retrieved: DataFrame, generator: Generator) -> DataFrame:
    """One response row for each row of `retrieved` (question, language, chunks and columns of its own).

    `chunks` is an array of structs in rank order with `content` and `relevance_score`; it may be null or empty.
    """
    own = [c for c in retrieved.columns if c not in ("question", "language", "chunks")]
    df = retrieved.withColumn("chunks", F.coalesce("chunks", F.slice("chunks", 1, 0), F.from_json(F.lit("[]"), retrieved.schema["chunks"].dataType)))
    df = df.withColumn("texts", F.transform("chunks", lambda c: c["content"])).withColumn("prompt", answer_prompt(
        F.coalesce("question", F.lit("")), F.coalesce(context_block(F.transform("chunks", lambda c: c["content"])), F.lit("")), F.col("language")))
    got = generator(df)
    failed = F.col("reply").isNull()
    relevances = F.transform("chunks", lambda c: c["relevance_score"])
    return got.select(
        *own, "question", F.when(failed, error_text(F.col("language"), F.col("error"))).otherwise(F.col("reply")).alias("response"),
        F.when(failed, 0.0).otherwise(confidence(F.col("reply"), relevances, F.coalesce("finished", F.lit(False)))).alias("confidence"),
        F.when(failed, 0.0).otherwise(F.col("generation_time")).alias("generation_time"), "model_used", F.col("chunks").alias("chunks_used"),
        F.when(failed, F.coalesce("error", F.lit("no reply"))).alias("error"))

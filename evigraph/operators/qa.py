"""Reading passages with a language model, and scoring its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_answer, normalize_answer
from ..sources.seams import LanguageModel, answered


def reading_prompts(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, prompt: the passages of a question in rank order, a line each, then the question.  ranked: qid, rank, text."""
    context = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    lines = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    prompt = F.concat(F.lit("Use these passages to answer.\n"), F.coalesce(lines, F.lit("")), F.lit("\nQuestion: "), "question", F.lit("\nEnd with 'Answer:' and a short answer."))
    return questions.join(context, "qid", "left").select("qid", prompt.alias("prompt"))


def read(questions: DataFrame, ranked: DataFrame, model: LanguageModel) -> DataFrame:
    """qid, pred_answer, status."""
    return answered(reading_prompts(questions, ranked), "prompt", "qid", model).select("qid", last_answer(F.col("raw_output")).alias("pred_answer"), "status")


def contained(pred: Column, gold: Column, strict: bool = False) -> Column:
    """1 if the normalised gold answer occurs in the normalised prediction; blank ones give 0.

    A gold answer that normalises to nothing, such as an article alone, is in every prediction unless `strict`.
    """
    p, g = normalize_answer(pred), normalize_answer(gold)
    blank = (F.trim(F.coalesce(pred, F.lit(""))) == "") | (F.trim(F.coalesce(gold, F.lit(""))) == "")
    return F.when(blank | ((g == "") & F.lit(strict)), 0).otherwise(F.contains(p, g).cast("int"))


def judged(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """qid, llm_accuracy: 1.0 where the model's normalised verdict is "correct".  rows: qid, question, gold, pred_answer."""
    prompt = F.concat_ws("\n", F.lit("Is the prediction right? Reply with correct or incorrect."), F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Expected: "), F.coalesce("gold", F.lit(""))), F.concat(F.lit("Prediction: "), F.coalesce("pred_answer", F.lit(""))))
    out = answered(rows.select("qid", prompt.alias("prompt")), "prompt", "qid", model)
    return out.select("qid", (normalize_answer(last_answer(F.col("raw_output"))) == "correct").cast("double").alias("llm_accuracy"))


def evaluate(rows: DataFrame, model: LanguageModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with contain_accuracy and llm_accuracy, their means); no rows give null means."""
    out = rows.withColumn("contain_accuracy", contained(F.col("pred_answer"), F.col("gold")))
    out = out.join(judged(rows, model), "qid", "left") if model else out.withColumn("llm_accuracy", F.lit(None).cast("double"))
    return out, out.agg(F.avg("llm_accuracy").alias("llm_accuracy"), F.avg("contain_accuracy").alias("contain_accuracy"))

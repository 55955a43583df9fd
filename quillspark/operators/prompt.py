"""Prompt assembly and the extractive answerer (P1 to P7), and the hook for a real model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Prompt wording and refusals: fixed values.
REFUSAL = "The supplied documents do not allow a conclusion."
REFUSAL_FR = "Les documents fournis ne permettent pas de conclure."
NO_EVIDENCE = "(no excerpt matched this question)"
SYSTEM = """You are an offline assistant answering strictly from the supplied excerpts.

Rules:
1. Use only the excerpts below. Never rely on outside knowledge.
2. Cite the excerpt label in square brackets after each claim, e.g. [S1].
3. If the excerpts do not contain the answer, reply exactly: {refusal}
4. Quote figures, dates and amounts exactly as they appear.
5. Answer in the language of the question. Be concise and factual.
"""
USER = ("### Excerpts\n", "\n\n### Question\n", "\n\n### Answer\n")
MOST_CHARS = 20_000


def refusal(question: Column) -> Column:
    return F.when(T.looks_french(question), REFUSAL_FR).otherwise(REFUSAL)


def render_evidence(evidence: DataFrame, questions: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """question_id, excerpts, labels and left_out; blocks in pick order up to the first that does not fit
    into `most_chars`, and how many did not."""
    path = F.when(F.size("section_path") > 0, F.concat(F.lit(" > "), F.array_join("section_path", " > "))).otherwise("")
    block = F.concat(F.lit("["), "label", F.lit("] "), "document_name", path, F.lit("\n"), T.strip(F.col("text")))
    order = Window.partitionBy("question_id").orderBy("pick")
    rows = evidence.select("question_id", "pick", "label", block.alias("block"))
    rows = rows.withColumn("fits", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= most_chars)
    kept = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("pick", "label", "block"))))
    grouped = rows.groupBy("question_id").agg(kept.alias("kept"), F.count_if(~F.col("fits")).alias("left_out"))
    joined = lambda c, x: F.when(F.size("kept") > 0, x).alias(c)
    shown = grouped.select("question_id", joined("excerpts", F.array_join(F.transform("kept", lambda x: x["block"]), "\n\n")), F.transform("kept", lambda x: x["label"]).alias("labels"), "left_out")
    out = questions.join(shown, "question_id", "left")
    return out.withColumns({"excerpts": F.coalesce("excerpts", F.lit(NO_EVIDENCE)), "labels": F.coalesce("labels", F.array().cast("array<string>")), "left_out": F.coalesce("left_out", F.lit(0))})


def build_prompt(rendered: DataFrame, context_tokens: int = 4096, output_tokens: int = 512) -> DataFrame:
    """Prompt, its token counts, efficiency and whether it overflows the window."""
    before, after = SYSTEM.split("{refusal}")
    prompt = F.concat(F.lit(before), refusal(F.col("question")), F.lit(after + "\n" + USER[0]), "excerpts", F.lit(USER[1]), T.strip(F.col("question")), F.lit(USER[2]))
    rows = rendered.withColumn("prompt", prompt)
    rows = rows.withColumns({"prompt_tokens": T.token_count(F.col("prompt")), "evidence_prompt_tokens": T.token_count(F.col("excerpts"))})
    efficiency = F.when(F.col("prompt_tokens") <= 0, 0.0).otherwise(F.round(F.col("evidence_prompt_tokens") / F.col("prompt_tokens"), 4))
    return rows.withColumns({"efficiency": efficiency, "overflows": F.col("prompt_tokens") > context_tokens - output_tokens})


def extractive_answer(prompts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first three sentences of the first excerpt with its label; a refusal without any."""
    first = evidence.where("pick = 1").select("question_id", F.col("text").alias("first_text"), F.col("label").alias("first_label"))
    pieces = F.filter(F.transform(F.split(T.strip(F.col("first_text")), r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: s != "")
    quoted = F.concat(F.array_join(F.slice(pieces, 1, 3), " "), F.lit(" ["), "first_label", F.lit("]"))
    rows = prompts.join(first, "question_id", "left").withColumn("answer", F.coalesce(quoted, refusal(F.col("question"))))
    return rows.drop("first_text", "first_label").withColumns({"is_simulated": F.lit(True), "generated_tokens": T.token_count(F.col("answer"))})


def unlabelled_answer(question: Column, body: Column) -> Column:
    """The two sentences of a body that share most words with the question, first ones on ties."""
    pieces = F.filter(F.transform(F.split(body, r"(?U)(?<=[.!?])\s+|\n"), T.strip), lambda s: F.length(s) > 25)
    wanted = F.array_distinct(T.content_words(question))
    overlap = lambda s: F.size(F.array_intersect(wanted, T.content_words(s)))
    scored = F.sort_array(F.transform(pieces, lambda s, i: F.struct((-overlap(s)).alias("o"), F.array_position(pieces, s).alias("i"), s.alias("s"))))
    top = F.array_join(F.transform(F.slice(scored, 1, 2), lambda x: x["s"]), " ")
    plain = F.array_join(F.slice(pieces, 1, 2), " ")
    # the language of a refusal follows the prompt's wording
    declined = F.when(T.contains_any(F.lower(body), ("les extraits", "la question")), REFUSAL_FR).otherwise(REFUSAL)
    best = F.try_element_at(scored, F.lit(1))["o"]
    return (
        F.when((T.strip(body) == "") | F.contains(body, F.lit("no excerpt matched")), declined)
        .when(F.size(pieces) == 0, REFUSAL_FR)
        .when(F.size(wanted) == 0, plain)
        .when(best == 0, declined)
        .otherwise(top)
    )


Generator = Callable[[list[str]], list[str]]


def generate(prompts: DataFrame, generator: Generator) -> DataFrame:
    """Answers from a real model, called with batches of prompts inside Arrow batches."""
    @F.pandas_udf("string")
    def answers(batch: pd.Series) -> pd.Series:
        return pd.Series(generator(batch.tolist()))

    return prompts.withColumns({"answer": answers("prompt"), "is_simulated": F.lit(False)})


def choose_backend(name: str = "auto", model: Generator | None = None):
    """The extractive answerer unless a model is given, or asked for and missing."""
    if name not in ("auto", "extractive", "model"):
        raise ValueError(f"unknown backend {name!r}")
    if name == "model" and model is None:
        raise ValueError("a model is asked for and none is given")
    return extractive_answer if model is None or name == "extractive" else lambda prompts, evidence: generate(prompts, model)


def tokens_per_second(generated: Column, total_ms: Column, first_ms: Column) -> Column:
    """P10."""
    return F.coalesce(F.try_divide(generated * 1000.0, F.when(total_ms > first_ms, total_ms - first_ms)), F.lit(0.0))

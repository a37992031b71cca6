"""Tasks and models behind small protocols: what is asked, who answers, and what counts as right."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_answer
from .tables import slice_task

#: Gives a text for each prompt; it is called in the workers, so it opens there what it needs.
Responder = Callable[[list[str]], list[str]]


def last_line(prompts: list[str]) -> list[str]:
    """The responder without a model: the last line of the prompt that says something."""
    return [next((x.strip() for x in reversed((p or "").split("\n")) if x.strip()), "") for p in prompts]


def respond(df: DataFrame, prompt: str, responder: Responder = last_line, retries: int = 1, column: str = "response", batch: int = 64, partitions: int | None = None) -> DataFrame:
    """df with a struct<text, attempts, error> for each prompt. An empty answer or an exception counts as a failure and is
    asked again, up to `retries` times and prompt by prompt; what fails for good has a null text and says why. partitions
    bounds how many tasks ask at once."""

    @F.pandas_udf("struct<text: string, attempts: int, error: string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            prompts, out = series.tolist(), {}
            for attempt in range(1, retries + 2):
                open_ = [i for i in range(len(prompts)) if i not in out or out[i][0] is None]
                step = batch if attempt == 1 else 1
                for at in range(0, len(open_), step):
                    some = open_[at : at + step]
                    try:
                        said, why = [(x or "").strip() for x in responder([prompts[i] for i in some])], "empty response"
                    except Exception as e:  # one prompt's failure is not the job's
                        said, why = [""] * len(some), f"{type(e).__name__}: {e}"[:160]
                    out.update((i, (x or None, attempt, None if x else why)) for i, x in zip(some, said))
            yield pd.DataFrame([out[i] for i in range(len(prompts))], columns=["text", "attempts", "error"])

    rows = df if partitions is None else df.coalesce(partitions)
    return rows.withColumn(column, ask(F.col(prompt)))


def to_conversation(df: DataFrame, kind: str) -> DataFrame:
    """df(id, ...) -> (id, turn, role, text). "question_answer" has question and answer, "choices" question, choices,
    letters and gold (a place), "completion" prompt and solution."""
    from ..functions.text import render_choices

    if kind == "question_answer":
        asked, said = F.col("question"), F.col("answer")
    elif kind == "choices":
        asked, said = render_choices(F.col("question"), F.col("choices"), F.col("letters")), F.get("letters", F.col("gold"))
    elif kind == "completion":
        asked, said = F.col("prompt"), F.concat("prompt", F.lit("\n"), "solution")
    else:
        raise ValueError(f"unknown kind {kind}")
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), asked.alias("text")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), said.alias("text")))
    return df.select("id", F.inline(turns))


def evaluate_answers(df: DataFrame, kind: str = "number") -> DataFrame:
    """df(reference, answer) with is_correct: "number" compares the numbers after #### (both missing counts as equal),
    "letter" the texts themselves."""
    if kind == "number":
        same = extract_answer(F.col("answer")).eqNullSafe(extract_answer(F.col("reference")))
    elif kind == "letter":
        same = F.coalesce(F.col("answer") == F.col("reference"), F.lit(False))
    else:
        raise ValueError(f"unknown kind {kind}")
    return df.withColumn("is_correct", same)


class Task:
    """Items as a table (idx from 0, prompt, reference), sliced at will, and a rule that judges an answer."""

    def __init__(self, items: DataFrame, kind: str = "number", start: int = 0, stop: int | None = None, step: int = 1):
        if start < 0 or step < 1 or (stop is not None and stop < start):
            raise ValueError("a slice goes forward from 0 or later")
        self.kind, self.items = kind, slice_task(items, start, stop, step)

    def evaluate(self, answers: DataFrame) -> DataFrame:
        return evaluate_answers(answers, self.kind)

    def run(self, responder: Responder = last_line, **options) -> DataFrame:
        """(idx, prompt, reference, answer, is_correct) with a responder's answers."""
        said = respond(self.items, "prompt", responder, **options)
        return self.evaluate(said.select("idx", "prompt", "reference", F.col("response.text").alias("answer")))

"""A place for text generators: any callable on a batch of prompts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[list[str]], list[str]]


def stub(prompts: list[str]) -> list[str]:
    """A verdict that depends on the prompt alone."""
    return [f"Winner: Response {'AB'[hashlib.sha256(p.encode()).digest()[0] % 2]}" for p in prompts]


def generate(rows: DataFrame, load: Callable[[], Generator], prompt: str = "prompt", output: str = "output", batch: int = 32) -> DataFrame:
    """``rows`` with an output for each prompt (null: none).  ``load`` runs
    once a task; batches have up to ``batch`` prompts."""
    kept = [c for c in rows.columns if c != output]
    schema = rows.select(*kept, F.lit(None).cast("string").alias(output)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = load()
        for pdf in batches:
            asked = [i for i, p in enumerate(pdf[prompt]) if isinstance(p, str)]
            out: list[str | None] = [None] * len(pdf)
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                answers = answer([pdf[prompt].iat[i] for i in part])
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                for i, text in zip(part, answers, strict=True):
                    out[i] = text
            yield pdf.assign(**{output: out})

    return rows.select(*kept).mapInPandas(run, schema)

"""Guard scoring with a function of the user; failures stay with their row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptledger.functions.guard import guard_messages

SCORED = "request_id string, guard_raw_response string, guard_error string, guard_inference_ms double"


Conversation = list[dict]


def _answers(scorer: Callable[[list[Conversation]], list[str]], conversations: list[Conversation]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each conversation. A batch that fails is halved until the failure stands alone."""
    if not conversations:
        return []
    try:
        answers = list(scorer(conversations))
        if len(answers) != len(conversations):
            raise ValueError(f"{len(answers)} answers to {len(conversations)} conversations")
        return [(a, None) for a in answers]
    except Exception as e:  # noqa: BLE001 - one bad row must not fail the task
        if len(conversations) == 1:
            return [(None, str(e))]
        half = len(conversations) // 2
        return _answers(scorer, conversations[:half]) + _answers(scorer, conversations[half:])


def _batches(requests: DataFrame, run: Callable[[list[Conversation]], list[tuple]], schema: str, nothing: tuple, batch_size: int) -> DataFrame:
    """``run`` over batches of conversations; requests without text get ``nothing``."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                talks = [[] if m is None else [{"role": x["role"], "content": x["content"]} for x in m] for m in part["messages"]]
                spoken = [i for i, t in enumerate(talks) if t]
                begin = time.perf_counter()
                results = dict(zip(spoken, run([talks[i] for i in spoken]), strict=True))
                spent = round((time.perf_counter() - begin) * 1000 / max(1, len(spoken)), 2)
                rows = [(request_id, *(results.get(i, nothing)), spent if i in results else 0.0) for i, request_id in enumerate(part["request_id"])]
                yield pd.DataFrame(rows, columns=names)

    return requests.select("request_id", guard_messages(F.col("messages")).alias("messages")).mapInPandas(each, schema)


def score(requests: DataFrame, scorer: Callable[[list[Conversation]], list[str]], batch_size: int = 64) -> DataFrame:
    """Raw guard output per request. The scorer gets a batch of conversations; a request without text is not sent (``no_content``).

    ``guard_inference_ms`` is a request's share of its batch's time.
    """
    return _batches(requests, lambda talks: _answers(scorer, talks), SCORED, (None, "no_content"), batch_size)


ANSWERS = "array<struct<category:string,raw:string>>"


def score_categories(
    requests: DataFrame, scorer: Callable[[str, list[Conversation]], list[str]], categories: Sequence[str], flagged: Callable[[str], bool], batch_size: int = 64
) -> DataFrame:
    """``answers`` (category, raw) per request: categories are asked in order, and no further ones once an answer is flagged.

    A failed question counts as an empty answer. ``functions.guard.combine_risk_verdicts`` makes one verdict of the answers.
    """

    def run(talks: list[Conversation]) -> list[tuple]:
        asked: list[list[dict]] = [[] for _ in talks]
        left = list(range(len(talks)))
        for category in categories:
            answers = _answers(lambda batch, c=category: scorer(c, batch), [talks[i] for i in left])
            for i, (raw, _) in zip(left, answers, strict=True):
                asked[i].append({"category": category, "raw": raw})
            left = [i for i, (raw, _) in zip(left, answers, strict=True) if not (raw and flagged(raw))]
        return [(a,) for a in asked]

    return _batches(requests, run, f"request_id string, answers {ANSWERS}, guard_inference_ms double", ([],), batch_size)

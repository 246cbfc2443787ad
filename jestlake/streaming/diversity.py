"""Structure-diversity reward as a stream: the history of tags is kept as state per run.

A run is one serial history (one generating process); runs are independent, so a stream of many runs is parallel. Within a
micro-batch a run's rows are taken in the order of pos and cut into calls of `batch` rows; a call reads the history once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.diversity import HISTORY

OUTPUT = "run string, pos bigint, structure string, diversity double"


def score_calls(tags: list[str], history: list[str], batch: int) -> tuple[list[float], list[str]]:
    """Rewards of a run's further tags, and the history after them."""
    rewards: list[float] = []
    for start in range(0, len(tags), batch):
        call = tags[start : start + batch]
        seen = Counter(history)
        size, target = max(1, len(history)), 1.0 / max(1, len(seen))
        for i, tag in enumerate(call):
            rewards.append(target - seen[tag] / (size + i))
            seen[tag] += 1
        history = (history + call)[-HISTORY:]
    return rewards, history


def stream_diversity(rows: DataFrame, batch: int = 8) -> DataFrame:
    """rows: a stream of (run string, pos bigint, structure string). Whole calls should arrive together.

    A row without a structure resets its run: it gives no row, and the history begins anew behind it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(parts)).sort_values("pos", kind="stable")
        history = list(state.get[0]) if state.exists else []
        resets = frame["structure"].isna()
        for begun, part in frame.groupby(resets.cumsum()):
            if begun:
                history, part = [], part.iloc[1:] if resets.loc[part.index[0]] else part
            if part.empty:
                continue
            rewards, history = score_calls(part["structure"].tolist(), history, batch)
            yield pd.DataFrame({"run": key[0], "pos": part["pos"].to_numpy(), "structure": part["structure"].to_numpy(), "diversity": pd.Series(rewards, dtype="float64")})
        state.update((history,))

    return rows.groupBy("run").applyInPandasWithState(step, OUTPUT, "history array<string>", "append", GroupStateTimeout.NoTimeout)

"""Calls of outside models from partitions: bounded concurrency, retries, failures as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "result string, status string, attempts int, error string"


def pause(attempt: int) -> int:
    """Seconds before a further attempt: 1, 2, 4, 8, then 16."""
    return min(2**attempt, 16)


def call_models(rows: DataFrame, key: str, request: str, client: Callable[[str], str], retries: int = 2, concurrency: int = 4, wait: Callable[[int], float] = pause) -> DataFrame:
    """(key, result, status, attempts, error): ``client`` on each request; concurrency is the number of partitions.

    A call that fails after all retries gives status 'fallback' and no result; the job goes on. A null request is 'skipped'.
    Checkpoint the result before using it twice, so that no call is paid for again.
    """
    if not 0 <= retries <= 5 or not 1 <= concurrency <= 32:
        raise ValueError("retries go from 0 to 5, concurrency from 1 to 32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, r in zip(b[key], b[request]):
                if r is None:
                    out.append((k, None, "skipped", 0, None))
                    continue
                error = None
                for attempt in range(retries + 1):
                    try:
                        out.append((k, client(r), "ok", attempt + 1, None))
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a model is a row
                        error = f"{type(e).__name__}: {str(e)[:500]}"
                        if attempt < retries:
                            time.sleep(wait(attempt))
                else:
                    out.append((k, None, "fallback", retries + 1, error))
            yield pd.DataFrame(out, columns=[key, "result", "status", "attempts", "error"])

    return rows.select(key, request).repartition(concurrency).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {RESULT}")

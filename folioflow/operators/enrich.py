"""Rows enriched by a callable (a model), with a log of its calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: After so many failures in a row without a success, a partition asks no more.
STOP_AFTER = 3


def stub(text: str) -> tuple[str, int, int]:
    """A deterministic stand-in for a model: (text, prompt tokens, completion tokens)."""
    if not text:
        raise ValueError("nothing to read")
    return text.upper(), len(text), len(text)


def enrich_rows(rows: DataFrame, key: str, text: str, call: Callable[[str], tuple[str, int, int]] = stub) -> DataFrame:
    """One row for each call: (key, result, ok, prompt_tokens, completion_tokens, error). The calls made are its own log: a
    call counts even if its result is used by no one. A partition in which nothing succeeds stops after three; a row without text
    isn't a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed, worked = 0, False
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                if not worked and failed >= STOP_AFTER:
                    break
                try:
                    result, prompt, completion = call(t)
                    out.append((k, result, True, prompt, completion, None))
                    worked, failed = True, 0
                except Exception as e:  # noqa: BLE001  a model's failures are of any kind, and are logged
                    out.append((k, None, False, 0, 0, str(e)[:200]))
                    failed += 1
            yield pd.DataFrame(out, columns=[key, "result", "ok", "prompt_tokens", "completion_tokens", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, result string, ok boolean, prompt_tokens bigint, completion_tokens bigint, error string")

"""Recognition systems as plug-ins: what reads pictures is the caller's, what counts is checked here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class System(Protocol):
    """``read`` gives the text of one picture; a ``batch`` method, where there is one, those of many in order."""

    name: str

    def read(self, picture: Any) -> str: ...


def run_system(rows: DataFrame, make: Callable[[], System], key: str, picture: str, ref: str) -> DataFrame:
    """``(key, ref, hyp, system)`` for every row, in Arrow batches; *make* builds the system once a task.

    A picture that is null reads as an empty text and is never dropped.  A batch method that gives more or
    fewer texts than it got pictures raises, as predictions would slip against references.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = make()
        for b in batches:
            there = [p for p in b[picture] if p is not None]
            if hasattr(system, "batch"):
                got = list(system.batch(there))
                if len(got) != len(there):
                    raise ValueError(f"{system.name}: {len(got)} texts for {len(there)} pictures")
            else:
                got = [system.read(p) for p in there]
            texts = iter(got)
            hyp = ["" if p is None else (next(texts) or "") for p in b[picture]]
            yield pd.DataFrame({key: b[key], ref: b[ref], "hyp": hyp, "system": system.name})

    return rows.select(key, ref, picture).mapInPandas(run, f"`{key}` {kinds[key]}, `{ref}` {kinds[ref]}, hyp string, system string")

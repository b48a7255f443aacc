"""Groups of rows inside a task, streamed over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of equal keys in a partition that is sorted by them; a run may span batches."""
    now, rows = None, []
    for batch in batches:
        for key, row in zip(batch[keys].itertuples(index=False, name=None), batch.itertuples(index=False, name=None), strict=True):
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows

"""Row-wise operations over unbounded input.

The request language has no streaming of its own; its stateless operations hold for each
micro-batch of a Structured Streaming frame as they do for a table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import INVALID_ARGUMENT, FrameError
from ..operators import missing, relational, reshape

STATELESS: dict[str, Callable[[DataFrame, Mapping[str, Any]], DataFrame]] = {
    "dataframe_select": relational.select,
    "dataframe_rename": relational.rename,
    "dataframe_with_column": relational.with_column,
    "dataframe_filter": relational.filter_rows,
    "dataframe_unnest": reshape.unnest,
    "dataframe_unpivot": reshape.unpivot,
    "dataframe_dropna": missing.dropna,
}


def apply_stream(frame: DataFrame, steps: Sequence[tuple[str, Mapping[str, Any]]]) -> DataFrame:
    """The streaming frame with the steps applied; operations that need all rows are refused."""
    for op, params in steps:
        if op not in STATELESS:
            raise FrameError(INVALID_ARGUMENT, f"'{op}' needs all rows and can't run over a stream.", operation=op)
        frame = STATELESS[op](frame, params)
    return frame


def write_stream(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet files, each row once; all input that is there is taken, then the query ends."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

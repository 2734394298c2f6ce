"""The newest state of each key from a log that is read as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvstrata.sources.log import LOG

_STATE = "seq bigint, is_tombstone boolean, value binary"


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _latest(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, tombstone, value = state.get if state.exists else (-1, True, None)
    changed = False
    for f in frames:
        i = f["seq"].idxmax()
        if f.at[i, "seq"] > seq:
            seq, tombstone, value, changed = int(f.at[i, "seq"]), bool(f.at[i, "is_tombstone"]), f.at[i, "value"], True
    if changed:
        value = None if tombstone else value
        state.update((seq, tombstone, value))
        yield pd.DataFrame({"key": [key[0]], "seq": [seq], "is_tombstone": [tombstone], "value": [value]})


def latest(log: DataFrame) -> DataFrame:
    """Changes of each key's newest state, in update mode: a row whose seq isn't above the stored one is late and ignored."""
    return log.groupBy("key").applyInPandasWithState(_latest, f"key binary, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)

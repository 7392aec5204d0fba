"""The guest quota on a stream: one number per guest as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import GUEST_LIMIT, WARN_AT

_NO_TIME = np.iinfo(np.int64).min
_ROWS = 50_000


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nobody, guest, at, key) -> one row per guest of a batch, its times and keys as lists.

    A busy guest's messages travel as a few long lists instead of as rows.
    """
    for batch in batches:
        if len(batch):
            rows = pa.Table.from_batches([batch]).group_by(["nobody", "guest"]).aggregate([("at", "list"), ("key", "list")])
            yield from rows.rename_columns(["nobody", "guest", "at", "key"]).combine_chunks().to_batches()


def _number(limit: int, forget_ms: int | None):
    """Numbers a guest's messages of one micro-batch by time, from where the batches before left off."""
    def run(guest: tuple, packs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        packs = list(packs)
        at = np.concatenate([a for pack in packs for a in pack["at"]]).astype(np.int64)
        key = np.concatenate([k for pack in packs for k in pack["key"]]).astype(np.int64)
        before = state.get[0] if state.exists else 0
        state.update((before + len(at),))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        order = np.lexsort((key, at))
        number = before + 1 + np.arange(len(at))
        status = np.where(number > limit, "refused", np.where(np.isin(number - 1, WARN_AT), "warn", "ok"))
        for first in range(0, len(at), _ROWS):
            some = order[first:first + _ROWS]
            yield pd.DataFrame({"nobody": guest[0], "guest": guest[1], "at": at[some], "key": key[some], "message_no": number[first:first + _ROWS],
                                "status": status[first:first + _ROWS]})

    return run


def guest_quota_stream(messages: DataFrame, guest: str, at: str, key: str, limit: int = GUEST_LIMIT, forget_after_ms: int | None = None) -> DataFrame:
    """(guest, at, key, message_no, status) of a stream: ok / warn / refused, in order of arrival and, within a batch, of time.

    Spark keeps one number per guest and touches those of a batch's guests only; the rows' work
    is the batch's. Messages without a guest's name count as one guest, those without a time come
    first in their batch. `key` is a whole number that orders messages of one time. With
    `forget_after_ms` a guest who is silent for so long (in processing time) starts anew; that is
    for streams that run on, as Spark does not end a stream that waits for timers.
    """
    named = messages.select(F.col(guest).isNull().alias("nobody"), F.coalesce(F.col(guest).cast("string"), F.lit("")).alias("guest"),
                            F.coalesce(F.unix_micros(at), F.lit(int(_NO_TIME))).alias("at"), F.col(key).cast("long").alias("key"))
    packed = named.mapInArrow(_packs, "nobody boolean, guest string, at array<long>, key array<long>")
    timeout = GroupStateTimeout.NoTimeout if forget_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    numbered = packed.groupBy("nobody", "guest").applyInPandasWithState(
        _number(limit, forget_after_ms), "nobody boolean, guest string, at long, key long, message_no long, status string", "seen long", "append", timeout)
    kind = messages.schema[guest].dataType
    return numbered.select(F.when(~F.col("nobody"), F.col("guest")).cast(kind).alias(guest),
                           F.when(F.col("at") != int(_NO_TIME), F.timestamp_micros("at")).alias(at), F.col("key").alias(key), "message_no", "status")

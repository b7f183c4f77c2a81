"""Overrides arrive as events. One state per check holds what the last events said, so a batch costs what it holds, not what came before."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.audit import OVERRIDES

#: Of verdict, review mark and note: the value, and the seq of the event that said it last. Null seq: nothing has been said.
STATE = "verdict string, verdict_seq long, mark boolean, mark_seq long, note string, note_seq long"
RESULT = "check_id string, human_override string, reviewed boolean, note string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _later(held: tuple[Any, int | None], value: Any, seq: int) -> tuple[Any, int | None]:
    return (value, seq) if held[1] is None or seq >= held[1] else held


class Fold(StatefulProcessor):
    """The rules of ``operators.audit.fold_overrides``, event by event. As the event with the highest seq counts, order and repeats don't matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("said", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.said.get() if self.said.exists() else (None,) * 6
        verdict, mark, note = (held[0], held[1]), (held[2], held[3]), (held[4], held[5])
        for batch in rows:
            for seq, said, clear, reviewed, text in zip(*(batch[c] for c in ("seq", "verdict", "clear", "reviewed", "note")), strict=True):
                seq, clear = int(seq), not pd.isna(clear) and bool(clear)
                said = None if pd.isna(said) else said
                if not clear and said is not None and said not in OVERRIDES:
                    continue
                sets = not clear and said is not None
                if clear or sets:
                    verdict = _later(verdict, said if sets else None, seq)
                if sets or not pd.isna(reviewed):
                    mark = _later(mark, True if pd.isna(reviewed) else bool(reviewed), seq)
                note = _later(note, "" if pd.isna(text) else text, seq)
        if note[1] is not None:  # some event was valid
            self.said.update((*verdict, *mark, *note))
            yield pd.DataFrame({"check_id": [key[0]], "human_override": [verdict[0]], "reviewed": [bool(mark[0])], "note": [note[0]]})

    def close(self) -> None:
        pass


def folded(events: DataFrame) -> DataFrame:
    """Streaming: RESULT for each check that a batch touches. events: streaming, with the columns of ``fold_overrides``."""
    return events.groupBy("check_id").transformWithStateInPandas(Fold(), RESULT, "update", "none")


def start(events: DataFrame, log_path: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the events to a log, for the record alone, and then writes what becomes of the checks that each batch touches.

    Batches are written under their id, so a batch that is repeated after a failure replaces itself. State stands in the checkpoint.
    """
    spark = events.sparkSession
    log = events.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    log.awaitTermination()

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # the kind of store that keyed values need; a query keeps what it was started with
    try:
        return folded(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def state(spark, state_path: str) -> DataFrame:
    """The latest state of each check."""
    rows = spark.read.parquet(state_path)
    latest = rows.groupBy("check_id").agg(F.max_by(F.struct("human_override", "reviewed", "note"), "epoch").alias("s"))
    return latest.select("check_id", "s.*")

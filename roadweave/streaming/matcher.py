"""Fixed-lag matching of a stream: each trajectory keeps the last steps of its lattice and says where it is now.

Candidates come in any order and in any batches. A step waits in the state until the watermark has passed its time,
which is when no other of its trajectory can come before it any more; a timer of event time then decides it and all
that wait before it, in order. The state of a trajectory holds the steps within the watermark's delay and the last
``lag`` decided ones, so it doesn't grow with the trajectory. Which edges may follow each other is a table that is
joined to the candidates: each brings the edges that lead to its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.decode import MASKED, best_path

_OUT = "trajectory_id bigint, t bigint, ts timestamp, candidate_rank bigint, edge_idx bigint, path_score double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DIGITS = 9


class FixedLag(StatefulProcessor):
    """Decides the steps of one trajectory in order of event time, each by the best path over the last lag steps."""

    def __init__(self, lag: int, bonus: float, penalty: float):
        self._lag, self._bonus, self._penalty = lag, bonus, penalty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "at bigint, t bigint", "candidates string")
        self._window = handle.getListState("window", "step string")
        self._decided = handle.getValueState("decided", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # What is behind the watermark is late, even if the timers that decide its time come after this batch's rows.
        upto = max(self._decided.get()[0] if self._decided.exists() else 0, timerValues.getCurrentWatermarkInMs() * 1000)
        come: dict[tuple[int, int], dict] = {}
        for part in rows:
            for r in part.itertuples(index=False):
                if r.at > upto:
                    lead = [int(x) for x in r.leads] if r.leads is not None else []
                    come.setdefault((int(r.at), int(r.t)), {})[str(int(r.candidate_rank))] = [int(r.edge_idx), float(r.emission), lead]
        for step, found in come.items():
            held = json.loads(self._waiting.getValue(step)[0]) if self._waiting.containsKey(step) else {}
            if not held:
                self._handle.registerTimer(-(-step[0] // 1000))
            self._waiting.updateValue(step, (json.dumps(held | found),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted(tuple(step) for step in self._waiting.keys() if step[0] <= now)
        if not due:
            return
        window = [json.loads(s[0]) for s in self._window.get()] if self._window.exists() else []
        rows = []
        for at, t in due:
            found = json.loads(self._waiting.getValue((at, t))[0])
            self._waiting.removeKey((at, t))
            window = [*window, [[int(rank), *found[rank]] for rank in sorted(found, key=int)]][-self._lag :]
            path, kept = self._best(window)
            rank, edge = window[-1][path[-1]][:2]
            rows.append((key[0], t, pd.Timestamp(at, unit="us", tz="UTC"), rank, edge, float(kept[-1, path[-1]])))
        self._window.put([(json.dumps(step),) for step in window])
        self._decided.update((due[-1][0],))
        yield pd.DataFrame(rows, columns=["trajectory_id", "t", "ts", "candidate_rank", "edge_idx", "path_score"])

    def _best(self, window: list) -> tuple[list[int], np.ndarray]:
        k = max(map(len, window))
        e, a = np.full((len(window), k), MASKED), np.full((len(window) - 1, k, k), MASKED)
        for i, step in enumerate(window):
            e[i, : len(step)] = [round(c[2], _DIGITS) for c in step]
            if i:
                for q, (_, edge, _, leads) in enumerate(step):
                    for p, before in enumerate(window[i - 1]):
                        a[i - 1, p, q] = self._bonus if before[1] == edge or before[1] in leads else -self._penalty
        return best_path(e, a, None, _DIGITS)

    def close(self) -> None:
        pass


def match_stream(candidates: DataFrame, transitions: DataFrame, lag: int = 15, late: str = "10 minutes", bonus: float = 0.35, penalty: float = 0.7) -> DataFrame:
    """Rows (trajectory_id, t, ts, candidate_rank, edge_idx, path_score), one for every step of a stream of candidates.

    candidates is a stream of (trajectory_id, t, ts, candidate_rank, edge_idx, emission), transitions a table of
    (prev_edge_idx, curr_edge_idx). A candidate that stays on its edge or follows a legal predecessor gains the bonus,
    any other loses the penalty. Rows may be late by the given time against the latest seen; later ones are left out,
    as are rows of a step that has been decided. Steps of one time go by t; of rows with one rank in a step the last
    to come counts. Rows without a trajectory, t, time, rank, edge or emission are left out. The state store is
    RocksDB: the session's provider is set to it, as no other has timers.
    """
    spark = candidates.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)
    leads = transitions.groupBy(F.col("curr_edge_idx").alias("edge_idx")).agg(F.collect_set("prev_edge_idx").alias("leads"))
    names = ["trajectory_id", "t", "candidate_rank", "edge_idx", "emission"]
    known = candidates.select(*names, F.col("ts").cast("timestamp").alias("ts")).dropna()
    timed = known.withWatermark("ts", late).join(leads, "edge_idx", "left").withColumn("at", F.unix_micros("ts"))
    grouped = timed.select("trajectory_id", "t", "ts", "at", "candidate_rank", "edge_idx", "emission", "leads").groupBy("trajectory_id")
    return grouped.transformWithStateInPandas(FixedLag(lag, bonus, penalty), _OUT, "append", "EventTime")


def publish(matched: DataFrame, sink, checkpoint: str, seconds: int | None = None):
    """Starts a query that hands every batch's finite rows to sink(df, batch_id), at a fixed pace or as they come."""
    writer = matched.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda df, i: sink(df.where("path_score IS NOT NULL AND NOT isnan(path_score)"), i)).start()

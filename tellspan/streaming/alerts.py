"""Alert rules over streams: the state machine as a stateful operator, and rules evaluated on a schedule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import Engine, State, advance


def transitions(ticks: DataFrame) -> DataFrame:
    """(rule, at_ns, event) of a stream of evaluations (rule, at_ns, breaching, hold_ns).

    The state of each rule is kept with the stream's checkpoint, so a restart doesn't forget a
    pending breach. Evaluations of one micro-batch are taken in order of time; older ones than
    the state has seen are passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, firing, last = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).sort_values("at_ns")
        out = []
        now = State(since, firing)
        for at, breaching, hold in zip(rows["at_ns"], rows["breaching"], rows["hold_ns"]):
            if last is not None and at <= last:
                continue
            now, event = advance(now, bool(breaching), int(at), int(hold))
            last = int(at)
            if event:
                out.append((key[0], last, event))
        state.update((now.since, now.firing, last))
        yield pd.DataFrame(out, columns=["rule", "at_ns", "event"]).astype({"at_ns": "int64"})

    return ticks.groupBy("rule").applyInPandasWithState(step, "rule string, at_ns long, event string", "since long, firing long, last long", "append", GroupStateTimeout.NoTimeout)


def scheduled(clock: DataFrame, engine: Engine, send: Callable[[list], None], now_ns: Callable[[], int], checkpoint: str, every: str = "15 seconds") -> StreamingQuery:
    """Evaluate the engine's rules once a trigger; ``clock`` is any stream (``rate``). A late trigger is one evaluation, not several."""

    def put(_: DataFrame, __: int) -> None:
        news = engine.tick(now_ns())
        if news:
            send(news)

    return clock.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

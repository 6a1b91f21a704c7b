"""The adaptive threshold as a stateful stream, one state a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.operators.feedback import HIGHEST, INITIAL, LEAST_FEEDBACKS, LOWEST, RATE
from sheaf.session import ship

OUTPUT = "key string, seq long, threshold double"
STATE = "threshold double, n long, fast_n long, fast_ok long, slow_n long, slow_ok long"


def advance(state: tuple, path: str, accurate: bool) -> tuple:
    """The state after one feedback."""
    t, n, fast_n, fast_ok, slow_n, slow_ok = state
    n += 1
    if path == "fast":
        fast_n, fast_ok = fast_n + 1, fast_ok + bool(accurate)
    elif path == "slow":
        slow_n, slow_ok = slow_n + 1, slow_ok + bool(accurate)
    if n >= LEAST_FEEDBACKS:
        fast, slow = (ok / k if k else 0.0 for ok, k in ((fast_ok, fast_n), (slow_ok, slow_n)))
        step = -RATE if fast < 0.6 else RATE / 2 if fast > 0.85 and slow > 0.85 else 0.0
        t = round(max(LOWEST, min(HIGHEST, t + step)), 3)
    return t, n, fast_n, fast_ok, slow_n, slow_ok


def threshold_stream(events: DataFrame) -> DataFrame:
    """``key, seq, threshold`` after each feedback of a stream ``(key, seq, path, was_accurate)``; a batch is taken in order of ``seq``."""
    import pandas as pd

    ship(events.sparkSession)

    def run(key, batches, state: GroupState):
        now = state.get if state.exists else (INITIAL, 0, 0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples():
            now = advance(now, r.path, r.was_accurate)
            out.append((key[0], r.seq, now[0]))
        state.update(now)
        yield pd.DataFrame(out, columns=["key", "seq", "threshold"])

    return events.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


"""Supervision of token streams: stop a model that has begun to loop."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeweave.operators.entities import TAIL, TAIL_RATIO, TAIL_WORDS

OUT = "stream_id string, seen int, degraded boolean"
STATE = "tail string, seen int, degraded boolean"


def looping(tail: str) -> bool:
    """Ten equal last words, or a tail that compresses far too well."""
    words = [w.lower().rstrip(":,;.") for w in tail.split()[-TAIL_WORDS:]]
    if len(tail) >= 200 and len(words) == TAIL_WORDS and len(set(words)) == 1:
        return True
    return len(tail) >= 400 and len(tail) / max(len(zlib.compress(tail.encode())), 1) >= TAIL_RATIO


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState, quiet_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # the output has ended; its verdict was given with its last token
        state.remove()
        return
    tail, seen, bad = state.get if state.exists else ("", 0, False)
    for pdf in batches:
        new = "".join(pdf.sort_values("seq")["token"])
        tail, seen = (tail + new)[-max(TAIL, len(new)):], seen + len(new)
        # Every stretch of a long batch is looked at, not only its end.
        bad = bad or any(looping(tail[max(0, end - TAIL):end]) for end in range(len(tail), 0, -(TAIL // 2)))
        tail = tail[-TAIL:]
    state.update((tail, seen, bad))
    if quiet_ms is not None:
        state.setTimeoutDuration(quiet_ms)
    yield pd.DataFrame([(key[0], seen, bad)], columns=["stream_id", "seen", "degraded"])


def monitor(tokens: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """``(stream_id, seq, token)`` stream to the current verdict per output.

    State is a bounded tail per output. With ``quiet_ms`` it is removed once the output
    has been quiet for so long; such a stream runs on without new data, so a run that
    should end with its input leaves it out.
    """
    return tokens.groupBy("stream_id").applyInPandasWithState(
        lambda key, batches, state: _advance(key, batches, state, quiet_ms), OUT, STATE, "update",
        GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout)

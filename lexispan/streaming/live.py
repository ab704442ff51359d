"""Streaming forms of the history and of the burst filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.session import HISTORY


def settled_stream(events: DataFrame, user: str, ts: str, query: str, quiet: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """(user, ended, query): the last query of each burst, once the watermark has passed the quiet time behind it."""
    marked = events.withWatermark(ts, late)
    return marked.groupBy(user, F.session_window(ts, quiet).alias("burst")).agg(F.max_by(query, ts).alias(query)).select(user, F.col("burst.end").alias("ended"), query)


def history_stream(events: DataFrame, user: str, ts: str, query: str, most: int = HISTORY, keep: str = "30 days", late: str = "1 minute") -> DataFrame:
    """(user, place, query, ts): after each batch, the latest queries of every user with new ones, in update mode.

    The state of a user is the list itself: at most `most` queries, each once whatever its case, in the casing used last, the latest first.
    Queries older than `keep` behind the watermark leave it, and so does a user without any; nothing else is
    kept of the log. Of equal times the greater text is the later one. Rows without a user, a time or a query are left out.
    """
    user_type = events.schema[user].dataType.simpleString()
    length = pd.Timedelta(keep).value // 1000

    def update(key, batches, state):
        held = list(zip(*state.get)) if state.exists else []
        if state.hasTimedOut:
            edge = state.getCurrentWatermarkMs() * 1000 - length
        else:
            edge = max(0, state.getCurrentWatermarkMs()) * 1000 - length
            for part in batches:
                held += list(zip(part["__us"].tolist(), part["__q"].tolist()))
        latest: dict[str, tuple[int, str]] = {}
        for us, text in held:
            name = text.lower()
            if us >= edge and (name not in latest or (us, text) > latest[name]):
                latest[name] = (us, text)
        rows = sorted(latest.values(), reverse=True)[:most]
        if not rows:
            if state.exists:
                state.remove()
            return
        state.update(tuple(map(list, zip(*rows))))
        state.setTimeoutTimestamp(max(rows[-1][0] + length, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        if not state.hasTimedOut:
            out = pd.DataFrame(rows, columns=["__us", "q"])
            yield pd.DataFrame({user: [key[0]] * len(out), "place": range(1, len(out) + 1), query: out["q"], ts: pd.to_datetime(out["__us"], unit="us")})

    known = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull() & F.col(query).isNotNull()).withWatermark(ts, late)
    grouped = known.select(user, ts, F.unix_micros(ts).alias("__us"), F.col(query).alias("__q")).groupBy(user)
    return grouped.applyInPandasWithState(update, f"{user} {user_type}, place int, {query} string, {ts} timestamp", "times array<long>, texts array<string>", "update", GroupStateTimeout.EventTimeTimeout)

"""The review store as a stream: each card's scheduler state lives in the state store, one rating at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import RATINGS, SCHEDULED, STANDS, interval_days, next_stand, next_state


def scheduled_stream(ratings: DataFrame) -> DataFrame:
    """After each micro-batch, the state of the cards it rated. ratings: card, rating, ts (epoch seconds)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, d, last, n = state.get if state.exists else (None, None, None, 0)
        now = None if s is None else (s, d, last)
        rows = pd.concat(list(batches)).sort_values(["ts", "rating"], kind="stable")
        for r, t in rows[["rating", "ts"]].itertuples(index=False):
            now = next_state(now, RATINGS[r], float(t))
            n += 1
        state.update((*now, n))
        yield pd.DataFrame([(key[0], *now, now[2] + 86400 * interval_days(now[0]), n)], columns=["card", "stability", "difficulty", "last", "due", "reviews"])

    known = ratings.where(F.col("rating").isin(*RATINGS)).select(F.col("card").cast("string"), "rating", F.col("ts").cast("double"))
    return known.groupBy("card").applyInPandasWithState(update, SCHEDULED, "stability double, difficulty double, last double, reviews long", "update", GroupStateTimeout.NoTimeout)


def due_stream(ratings: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Rows (card, told, due, reviews): `rated` after a micro-batch's ratings of a card, `due` when it falls due by the clock of events, `withdrawn` when it ends. ratings: card, rating, at (timestamp). A card's timer is set to its due time and set anew with
    each rating; the rating `withdrawn` ends a card and its timer; ratings later than the watermark allows don't count, as unknown ones and those without card or time don't."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["card", "told", "due", "reviews"]
        if state.hasTimedOut:
            *_, due, n = state.get
            yield pd.DataFrame([(key[0], "due", due, n)], columns=columns)
            return
        s, d, last, place, due, n = state.get if state.exists else (None, None, None, 0, None, 0)
        now = None if s is None else (s, d, last)
        for r, t in pd.concat(list(batches)).sort_values(["ts", "rating"], kind="stable")[["rating", "ts"]].itertuples(index=False):
            if r == "withdrawn":
                now, place, n = None, 0, 0
                continue
            now = next_state(now, RATINGS[r], float(t))
            stand, wait = next_stand(STANDS[place], RATINGS[r])
            place, n = STANDS.index(stand), n + 1
            due = now[2] + (wait or 86400.0 * interval_days(now[0]))
        if now is None:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], "withdrawn", float("nan"), 0)], columns=columns)
            return
        state.update((*now, place, due, n))
        # the timer must lie after the watermark; what is due already is told when it moves on
        state.setTimeoutTimestamp(max(int(due * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], "rated", due, n)], columns=columns)

    known = ratings.where(F.col("rating").isin(*RATINGS, "withdrawn") & F.col("card").isNotNull() & F.col("at").isNotNull())
    timed = known.select(F.col("card").cast("string"), "rating", "at", (F.unix_micros("at") / 1e6).alias("ts")).withWatermark("at", late)
    held = "stability double, difficulty double, last double, place int, due double, reviews long"
    return timed.groupBy("card").applyInPandasWithState(update, "card string, told string, due double, reviews long", held, "append", GroupStateTimeout.EventTimeTimeout)


def enrolled_once(cards: DataFrame, late: str = "7 days") -> DataFrame:
    """Idempotent enrolment: the first row of each card within the watermark. cards: card, enrolled (timestamp)."""
    return cards.withWatermark("enrolled", late).dropDuplicatesWithinWatermark(["card"])

"""Spaced review: queues, statistics, and the published free-spacing scheduler as a fold over each card's ratings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published default parameters of the scheduler (version 5), its retention target and forgetting curve.
WEIGHTS = (0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621)
RETENTION, DECAY, FACTOR = 0.9, -0.5, 19 / 81
RATINGS = {"again": 1, "hard": 2, "good": 3, "easy": 4}


def is_due(due: Column, now: Column) -> Column:
    """A card without a due time is due."""
    return due.isNull() | (due <= now)


def due_queue(cards: DataFrame, now: Column, limit: int) -> DataFrame:
    return cards.where(is_due(F.col("due"), now)).orderBy(F.col("due").asc_nulls_first(), "card").limit(limit)


def strength_by_day(history: DataFrame) -> DataFrame:
    """Mean stability for each UTC day. history: ts (epoch seconds), stability."""
    return history.groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.avg("stability").alias("stability"), F.count("*").alias("reviews"))


def review_stats(cards: DataFrame, now: Column) -> DataFrame:
    """Totals over cards (due, reviews, passes) in one row."""
    passes, rated = F.sum("passes"), F.sum("reviews")
    return cards.agg(
        F.count("*").alias("total"),
        F.count_if(is_due(F.col("due"), now)).alias("due"),
        F.count_if(F.col("reviews") == 0).alias("new"),
        F.count_if(F.col("reviews") > 0).alias("reviewed"),
        F.coalesce(F.round(F.try_divide(passes, rated), 4), F.lit(0.0)).alias("retention"),
    )


def next_state(state: tuple[float, float, float] | None, rating: int, ts: float) -> tuple[float, float, float]:
    """(stability, difficulty, time) after a rating, without fuzz."""
    w = WEIGHTS

    def clamp(d: float) -> float:
        return min(max(d, 1.0), 10.0)

    def first_difficulty(r: int) -> float:
        return clamp(w[4] - math.exp(w[5] * (r - 1)) + 1)

    if state is None:
        return max(w[rating - 1], 0.001), first_difficulty(rating), ts
    s, d, last = state
    days = max((ts - last) / 86400, 0.0)
    recall = (1 + FACTOR * days / s) ** DECAY
    if days < 1:
        stable = s * math.exp(w[17] * (rating - 3 + w[18]))
    elif rating == 1:
        stable = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - recall)), s)
    else:
        bonus = (w[15] if rating == 2 else 1) * (w[16] if rating == 4 else 1)
        stable = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * (1 - recall)) - 1) * bonus)
    moved = d + (10 - d) * (-w[6] * (rating - 3)) / 9
    return max(stable, 0.001), clamp(w[7] * first_difficulty(4) + (1 - w[7]) * moved), ts


def interval_days(stability: float, retention: float = RETENTION) -> int:
    return max(round(stability / FACTOR * (retention ** (1 / DECAY) - 1)), 1)


SCHEDULED = "card string, stability double, difficulty double, last double, due double, reviews long"


def _stepped(state: Column, rating: Column, ts: Column) -> Column:
    """`next_state` as an expression. state: s, d, last, of which s is null before the first rating."""
    w = [F.lit(x) for x in WEIGHTS]

    def clamp(d: Column) -> Column:
        return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))

    first_difficulty = clamp(w[4] - F.exp(w[5] * (rating - 1)) + 1)
    s, d = state["s"], state["d"]
    days = F.greatest((ts - state["last"]) / 86400, F.lit(0.0))
    recall = F.pow(1 + FACTOR * days / s, F.lit(DECAY))
    same_day = s * F.exp(w[17] * (rating - 3 + w[18]))
    forgot = F.least(w[11] * F.pow(d, -w[12]) * (F.pow(s + 1, w[13]) - 1) * F.exp(w[14] * (1 - recall)), s)
    bonus = F.when(rating == 2, w[15]).otherwise(1.0) * F.when(rating == 4, w[16]).otherwise(1.0)
    grown = s * (1 + F.exp(w[8]) * (11 - d) * F.pow(s, -w[9]) * (F.exp(w[10] * (1 - recall)) - 1) * bonus)
    stable = F.when(s.isNull(), F.element_at(F.array(*w[:4]), rating)).when(days < 1, same_day).when(rating == 1, forgot).otherwise(grown)
    moved = d + (10 - d) * (-w[6] * (rating - 3)) / 9
    easy = clamp(w[4] - F.exp(w[5] * 3) + 1)
    return F.struct(F.greatest(stable, F.lit(0.001)).alias("s"), F.when(s.isNull(), first_difficulty).otherwise(clamp(w[7] * easy + (1 - w[7]) * moved)).alias("d"), ts.alias("last"))


def _histories(ratings: DataFrame) -> DataFrame:
    """Each card's known ratings in order of time."""
    number = F.element_at(F.create_map(*[F.lit(x) for r in RATINGS.items() for x in r]), F.col("rating"))
    known = ratings.where(F.col("rating").isin(*RATINGS)).select(F.col("card").cast("string").alias("card"), F.struct(F.col("ts").cast("double").alias("ts"), "rating", number.alias("number")).alias("one"))
    return known.groupBy("card").agg(F.array_sort(F.collect_list("one")).alias("history"))


def _days(stability: Column) -> Column:
    """`interval_days` as an expression."""
    return F.greatest(F.bround(stability / FACTOR * (RETENTION ** (1 / DECAY) - 1)), F.lit(1.0))


def scheduled(ratings: DataFrame) -> DataFrame:
    """Each card's state after all its ratings in order of time, as a fold over the card's sorted history (a time and a number for each rating). ratings: card, rating, ts (epoch seconds)."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("s"), none.alias("d"), none.alias("last"))
    x = _histories(ratings).select("card", F.size("history").cast("long").alias("reviews"), F.aggregate("history", start, lambda a, r: _stepped(a, r["number"], r["ts"])).alias("now"))
    return x.select("card", F.col("now.s").alias("stability"), F.col("now.d").alias("difficulty"), F.col("now.last").alias("last"), (F.col("now.last") + 86400 * _days(F.col("now.s"))).alias("due"), "reviews")


# The scheduler's short steps before a new card, and one that was forgotten, is reviewed in days. In seconds.
LEARNING, RELEARNING = (60, 600), (600,)
#: Where a card stands, by number: each step of learning, each of learning anew, and review.
STANDS = [("learning", k) for k in range(len(LEARNING))] + [("relearning", k) for k in range(len(RELEARNING))] + [("review", 0)]


def next_stand(stand: tuple[str, int], rating: int) -> tuple[tuple[str, int], float]:
    """Where a card stands after a rating, and the seconds until it is due; 0 where its interval in days decides."""
    phase, k = stand
    if phase == "review":
        return (("relearning", 0), float(RELEARNING[0])) if rating == RATINGS["again"] else (stand, 0.0)
    steps = LEARNING if phase == "learning" else RELEARNING
    if rating == RATINGS["again"]:
        return (phase, 0), float(steps[0])
    if rating == RATINGS["hard"]:
        between = steps[0] * 1.5 if len(steps) == 1 else (steps[0] + steps[1]) / 2
        return stand, float(steps[k] if k else between)
    if rating == RATINGS["good"] and k + 1 < len(steps):
        return (phase, k + 1), float(steps[k + 1])
    return ("review", 0), 0.0


def scheduled_in_steps(ratings: DataFrame) -> DataFrame:
    """Each card's state after all its ratings, with short steps: card, phase, step (null in review), stability, difficulty, last, due and reviews. A card begins
    at the first step of learning. Ratings that aren't known are left out, as are cards without any; equal times go by name of the rating; null cards are one card."""
    table = [next_stand(x, r) for x in STANDS for r in RATINGS.values()]
    places, waits = F.array(*[F.lit(STANDS.index(x)) for x, _ in table]), F.array(*[F.lit(w) for _, w in table])
    none = F.lit(None).cast("double")
    start = F.struct(F.struct(none.alias("s"), none.alias("d"), none.alias("last")).alias("memory"), F.lit(0).alias("place"), F.lit(0.0).alias("wait"))

    def rated(a: Column, r: Column) -> Column:
        cell = a["place"] * len(RATINGS) + r["number"]
        return F.struct(_stepped(a["memory"], r["number"], r["ts"]).alias("memory"), F.element_at(places, cell).alias("place"), F.element_at(waits, cell).alias("wait"))

    x = _histories(ratings).select("card", F.size("history").cast("long").alias("reviews"), F.aggregate("history", start, rated).alias("now"))
    m = F.col("now.memory")
    wait = F.when(F.col("now.wait") > 0, F.col("now.wait")).otherwise(86400 * _days(m["s"]))
    name, step = (F.element_at(F.array(*[F.lit(v) for v in column]), F.col("now.place") + 1) for column in zip(*STANDS))
    return x.select("card", name.alias("phase"), F.when(name != "review", step).alias("step"), m["s"].alias("stability"), m["d"].alias("difficulty"), m["last"].alias("last"), (m["last"] + wait).alias("due"), "reviews")


def enrolled(cards: DataFrame, new: DataFrame) -> DataFrame:
    """Cards with those of `new` that aren't there yet, which begin without history and are due at once. new: card, quiz_id."""
    fresh = new.select("card", "quiz_id").dropDuplicates(["card"]).join(cards.select("card"), "card", "left_anti")
    return cards.unionByName(fresh.withColumn("reviews", F.lit(0).cast("long")), allowMissingColumns=True)


def withdrawn(cards: DataFrame, quizzes: DataFrame) -> DataFrame:
    """Cards less those of deleted quizzes. quizzes: quiz_id."""
    return cards.join(quizzes.select("quiz_id").distinct(), "quiz_id", "left_anti").select(*cards.columns)

"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated for each source; the targets follow by water filling; a document of a source with repetition rate r is emitted floor(r) times
and once more by a hash-seeded draw of probability r - floor(r): its hash is a place on a circle of length 1, its source turns the circle by one of TURNS equal
steps, and the copy is made if the place then lies below the fraction. What a source takes after each turn follows from sums over arcs, which one aggregation gives. A
source looks at the turn that comes nearest to its target from below and the one from above, and a number from its own name decides between them, with such chances that the
mean of both is the target. If no turn lies on one of the sides, as in sources of very few documents, a second hash of each document decides, which nothing was compared with.
So a source's words come near its target, and a copy still has the fraction as its probability: the mean of what a source takes is its target, and documents of
equal size have equal chances.

Defined cases: null text has size 0; a null source is a source of its own and sorts last; a source without
tokens has target 0 and is not emitted; equal rows are decided by their doc_id and the seed, so repeated
rows decide alike; an empty table gives no rows; further columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, stored

#: Weights by position of the source, repeating; no source is repeated more than MOST times.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
#: Steps that the circle of hashes can be turned by.
TURNS = 256
#: Up to so many sources are broadcast, so that texts needn't be shuffled by source.
MOST_BROADCAST = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): each source's target. There is one row for each source, so one small
    window ranks them. Sources are sorted by the point at which they reach their cap; the first k of them are
    capped if the level that the rest would then share lies at or below the next one's cap; from the first such k on, that level
    only falls, so it is the greatest of them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left_over", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level_here", F.col("left_over") / F.sum("weight").over(after))
        .withColumn("level", F.max(F.when(F.col("level_here") <= F.col("cap_level"), F.col("level_here"))).over(whole))
    )
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def _number(name: Column, at: int = 1) -> Column:
    """A number in [0, 1) of 32 bits from the MD5 sum of a name."""
    return F.conv(F.substring(F.md5(name), at, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _placed(rows: DataFrame, seed: str) -> DataFrame:
    """Rows with the place of their doc_id on the circle (arc, and how far into it) and its second number."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    place = _number(name) * TURNS
    return rows.withColumn("arc", F.floor(place).cast("int")).withColumn("into", place - F.floor(place)).withColumn("second", _number(name, 9))


def _turns(arcs: DataFrame, aims: DataFrame, seed: str) -> DataFrame:
    """(of_source, source_size, target, rate, steps, rest, turn): a source's copies are made at places of the first `steps` arcs and of the part `rest` of the next one after a turn
    by `turn` arcs; turn is null where the second numbers decide. arcs: of_source, arc, whole and part, its words and those in its part `rest`; at most TURNS rows for each source."""
    sums = F.map_from_entries(F.collect_list(F.struct("arc", F.struct("whole", "part"))))
    by_arc = arcs.groupBy(F.col("of_source").alias("by_source")).agg(sums.alias("sums"))
    x = by_arc.join(aims, F.col("by_source").eqNullSafe(F.col("of_source")))
    twice = F.sequence(F.lit(0), F.lit(2 * TURNS - 1))
    of_arc = F.transform(twice, lambda k: F.coalesce(F.try_element_at("sums", (k % TURNS).cast("int"))["whole"], F.lit(0).cast("long")))
    zero = F.array(F.lit(0).cast("long"))
    x = x.withColumn("up_to", F.aggregate(of_arc, zero, lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w))))
    base = F.floor("rate") * F.col("source_size")

    def taken(k: Column) -> Column:
        end = k + F.col("steps")
        return base + F.element_at("up_to", end + 1) - F.element_at("up_to", k + 1) + F.coalesce(F.try_element_at("sums", (end % TURNS).cast("int"))["part"], F.lit(0).cast("long"))

    x = x.withColumn("takes", F.transform(F.sequence(F.lit(0), F.lit(TURNS - 1)), lambda k: taken(k).cast("double")))
    x = x.withColumn("below", F.array_max(F.filter("takes", lambda t: t <= F.col("target")))).withColumn("above", F.array_min(F.filter("takes", lambda t: t >= F.col("target"))))
    lot = _number(F.concat(F.coalesce("of_source", F.lit("null")), F.lit(f":{seed}:source")))
    upper = F.coalesce(lot < F.try_divide(F.col("target") - F.col("below"), F.col("above") - F.col("below")), F.lit(False))
    turn = F.when(F.col("below").isNotNull() & F.col("above").isNotNull(), F.array_position("takes", F.when(upper, F.col("above")).otherwise(F.col("below"))) - 1)
    return x.select(*aims.columns, turn.cast("int").alias("turn"))


def _near(rows: DataFrame, aims: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's row; sources are broadcast where they are few, else joined by a shuffle."""
    return rows.join(F.broadcast(aims) if few else aims, F.col("source").eqNullSafe(F.col("of_source")), "left")


def rates(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each document: its own columns in a struct `doc`, its size, its source's size and target, and copies."""
    own = [docs["source"].alias("source"), docs["doc_id"].alias("doc_id"), words(docs["text"]).alias("size")]
    sizes = stored(docs.select(own[0], own[2]).groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    few = sizes.count() <= MOST_BROADCAST
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = targets(sizes, weights, most).withColumnRenamed("source", "of_source").withColumn("rate", rate)
    arc_of = (F.col("rate") - F.floor("rate")) * TURNS
    aims = aims.withColumn("steps", F.floor(arc_of).cast("int")).withColumn("rest", arc_of - F.floor(arc_of))
    placed = _near(_placed(docs.select(*own), seed), aims, few)
    arcs = placed.groupBy("of_source", "arc").agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("into") < F.col("rest"), F.col("size")).otherwise(F.lit(0))).cast("long").alias("part"))
    chosen = stored(_turns(arcs, aims, seed), "source-turns")
    discard(sizes)
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *own)
    at = F.pmod(F.col("arc") - F.col("turn"), F.lit(TURNS))
    turned = (at < F.col("steps")) | (at == F.col("steps")) & (F.col("into") < F.col("rest"))
    extra = F.when(F.col("turn").isNull(), F.col("second") < F.col("rate") - F.floor("rate")).otherwise(turned).cast("long")
    out = _near(_placed(sized, seed), chosen, few).withColumn("copies", F.least(F.floor("rate") + extra, F.lit(most).cast("long")))
    out._work_path = chosen._work_path
    return out


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of docs."""
    taken = rates(docs, seed, weights, most).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # only what the digest needs goes past the join
    return rates(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_sql(weights=WEIGHTS, most: int = MOST, seed: str = SEED, docs: str = "documents") -> str:
    """CTEs up to `mixed`: a row for each document with its copies."""
    weight = " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(weights))
    return f"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight, source_size * {most} AS cap, sum(source_size) OVER () AS total FROM sizes),
ranked AS (SELECT *, cap / weight AS cap_level, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
leveled AS (SELECT *, max(CASE WHEN (total - gone)::DOUBLE / weight_left <= cap_level THEN (total - gone)::DOUBLE / weight_left END) OVER () AS level FROM ranked),
aims AS (SELECT source AS of_source, source_size, least(cap::DOUBLE, coalesce(level, 0.0::DOUBLE) * weight) AS target FROM leveled),
rated AS (SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.of_source),
hashed AS (SELECT *, rate - floor(rate) AS fraction, floor((rate - floor(rate)) * {TURNS})::BIGINT AS steps, (rate - floor(rate)) * {TURNS} - floor((rate - floor(rate)) * {TURNS}) AS rest,
  md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}') AS h FROM rated),
placed AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT // {(1 << 32) // TURNS} AS arc, ('0x' || substr(h, 1, 8))::BIGINT % {(1 << 32) // TURNS} / {(1 << 32) // TURNS}.0::DOUBLE AS into_arc, ('0x' || substr(h, 9, 8))::BIGINT / {1 << 32}.0::DOUBLE AS second_number FROM hashed),
arcs AS (SELECT source, arc, any_value(target) AS target, any_value(floor(rate)::BIGINT * source_size) AS base, any_value(steps) AS steps, sum(size)::BIGINT AS whole, coalesce(sum(size) FILTER (into_arc < rest), 0)::BIGINT AS part FROM placed GROUP BY source, arc),
takes AS (SELECT source, turn, any_value(target) AS target, (any_value(base) + sum(CASE WHEN (arc - turn + {TURNS}) % {TURNS} < steps THEN whole WHEN (arc - turn + {TURNS}) % {TURNS} = steps THEN part ELSE 0 END))::DOUBLE AS takes
  FROM arcs, range({TURNS}) AS t(turn) GROUP BY source, turn),
sides AS (SELECT source, any_value(target) AS target, max(takes) FILTER (takes <= target) AS below, min(takes) FILTER (takes >= target) AS above FROM takes GROUP BY source),
lots AS (SELECT *, ('0x' || substr(md5(coalesce(source, 'null') || ':{seed}:source'), 1, 8))::BIGINT / {1 << 32}.0::DOUBLE AS lot FROM sides WHERE below IS NOT NULL AND above IS NOT NULL),
sided AS (SELECT source, CASE WHEN below < above AND lot < (target - below) / (above - below) THEN above ELSE below END AS side FROM lots),
chosen AS (SELECT t.source AS by_source, min(turn) AS turn FROM takes t JOIN sided s ON t.source IS NOT DISTINCT FROM s.source WHERE t.takes = side GROUP BY t.source),
turned AS (SELECT p.*, turn, (arc - turn + {TURNS}) % {TURNS} AS turned_arc FROM placed p LEFT JOIN chosen ON p.source IS NOT DISTINCT FROM by_source),
mixed AS (SELECT *, least(floor(rate)::BIGINT + (CASE WHEN turn IS NULL THEN second_number < fraction ELSE turned_arc < steps OR turned_arc = steps AND into_arc < rest END)::BIGINT, {most}) AS copies FROM turned)"""


SQL = {"op7_mix": f"WITH {mixing_sql()} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"}
QUERIES = {"op7_mix": op7_mix}

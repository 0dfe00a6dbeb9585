"""Which texts hold which patterns: one multi-pattern automaton reads a text once for all patterns of a part.

Distinct patterns are dealt by hash into parts of bounded size. A part is one broadcast, from which a worker builds an automaton that it keeps until another part comes;
a pass over the texts then writes the pairs it finds, and the next part's broadcast takes the place of the first. Texts aren't shuffled, no text meets a pattern one by one, and passes grow
with the patterns' bytes alone. Matches are of substrings; a pair is given once however often it occurs. Null and empty texts and patterns take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_spaced
from ..session import stored

#: UTF-8 bytes of patterns in a part; an automaton takes some sixty times as much.
PART_BYTES = 1 << 20

_automata: dict[str, object] = {}


def _automaton(name: str, rows: list[tuple[int, str]]):
    """The worker's automaton of a part; it holds one at a time."""
    if name not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for number, p in rows:
            made.add_word(p, number)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def containing(texts: DataFrame, patterns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs of a text and a pattern that it holds. texts: an id and a text; patterns: an id and a text, in this order of columns; the result has both ids."""
    spark = texts.sparkSession
    (text_id, text), (pattern_id, pattern) = texts.columns, patterns.columns
    distinct = patterns.where(F.length(pattern) > 0).select(F.col(pattern).alias("p")).distinct().withColumn("number", F.monotonically_increasing_id())
    distinct = stored(distinct, "patterns")
    size = distinct.agg(F.sum(F.octet_length("p"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    kind = texts.schema[text_id].dataType
    rows = texts.where(F.length(text) > 0).select(text_id, text)
    found = None
    for k in range(parts):
        mine = distinct.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == k).select("number", "p")
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])  # about part_bytes
        name = f"{id(shared)}-{shared._jbroadcast.id()}"

        def run(batches, shared=shared, name=name):
            machine = _automaton(name, shared.value) if shared.value else None
            for b in batches:
                own, numbers = [], []
                for i, t in enumerate(b.column(1).to_pylist() if machine else []):
                    hits = {n for _, n in machine.iter(t)}
                    own += [i] * len(hits)
                    numbers += hits
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int32())), pa.array(numbers, pa.int64())], names=[text_id, "number"])

        one = stored(rows.mapInArrow(run, f"`{text_id}` {kind.simpleString()}, number long"), "contained")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    names = patterns.select(pattern_id, F.col(pattern).alias("p")).join(distinct, "p").select(pattern_id, "number")
    return found.join(names, "number").select(text_id, pattern_id).distinct()


def titles_within(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of titles of which one holds the other, after they are made comparable. a and b: a title each, under different names."""
    (x,), (y,) = a.columns, b.columns
    own = a.distinct().select(x, norm_spaced(F.col(x)).alias("t"))
    other = b.distinct().select(y, norm_spaced(F.col(y)).alias("t"))
    return containing(own, other).select(x, y).union(containing(other, own).select(x, y)).distinct()

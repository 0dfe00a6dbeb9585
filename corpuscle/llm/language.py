"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counting: words of the training texts are reduced to character n-grams in each task and summed over all tasks, so every
training text counts. A model is a few sorted arrays of 64-bit hashes with probabilities and back-off weights of all n-grams, so that
discounts and continuation counts are those of the whole text; it grows with the distinct n-grams, and each language's is built in one task.
Words are modelled with the preceding four characters (word starts are padded), so a word's score doesn't depend on its
neighbours, and each distinct word is scored once in a worker.

A text gets the language of the lowest cross-entropy for each character. Rejection is calibrated on training
texts kept apart from counting, an equal share for each language as far as it has them: for each language the spread of their
cross-entropy, in deviations that shrink with length; beyond REJECT_AT of them, and REJECT_BITS over the mean, a text is rejected.

Defined cases: null, empty and letterless texts are `und` with score 0 and rejected; equal cross-entropies go to the
language first by code point; rows of null language don't train; without any training row every text is `und`;
repeated rows count as often as they occur; any length of text is processed whole; further columns pass through, but for those named lid_*, which are replaced; any number of languages
is told apart, one model each.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, frugal, mix, read, release

ORDER = 5
#: About so many training texts calibrate rejection and don't count.
CALIBRATION = 20_000
#: A rejected text lies so many deviations and so many bits a character above its language's mean.
REJECT_AT, REJECT_BITS, KEPT = 8.0, 1.25, 250_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_PAD, _END = "\x02", "\x03"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if there is no letter."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if found and not any(w.isalpha() for w in found) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of padded words one after another, and the offset of each word."""
    joined = "".join(_PAD * (ORDER - 1) + w + _END for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    # a lone surrogate can't come out of Arrow, so this encoding is total
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(size)])


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k code points that end at each position (the first k-1 positions mean nothing)."""
    out = np.full(len(points), k, np.uint64)
    x = points.astype(np.uint64)
    for j in range(k - 1, -1, -1):
        out = mix(out * _STEP + (np.concatenate([np.zeros(j, np.uint64), x[: len(x) - j]]) if j else x) + np.uint64(1))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of the highest-order n-grams of all given (lang, text)."""

    def run(batches):
        seen: dict[str, Counter] = {}

        def flush():
            for lang, counts in seen.items():
                grams: Counter = Counter()
                for w, n in counts.items():
                    s = _PAD * (ORDER - 1) + w + _END
                    for i in range(len(s) - ORDER + 1):
                        grams[s[i : i + ORDER]] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.keys(), pa.string()), pa.array(grams.values(), pa.int64())], names=["lang", "gram", "n"])
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > KEPT // 2:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(frugal(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated Kneser-Ney over n-grams of one language, as sorted hash arrays for each order."""

    def __init__(self, grams: list[str] | str, counts: np.ndarray):
        """grams: one after another, or a list of them."""
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        n = np.asarray(counts, np.float64)
        self.tables, self.weights = [None] * (ORDER + 1), [None] * (ORDER + 1)
        levels = []
        for k in range(ORDER, 0, -1):
            levels.append((k, points, n))
            # a lower order counts the different characters that stand before its n-grams
            rest, inverse = np.unique(points[:, 1:], axis=0, return_inverse=True)
            points, n = rest, np.bincount(inverse.ravel(), minlength=len(rest)).astype(np.float64)
        below = None
        for k, points, n in reversed(levels):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
            head, inverse = np.unique(points[:, :-1], axis=0, return_inverse=True)
            inverse = inverse.ravel()
            total = np.bincount(inverse, weights=n, minlength=len(head))
            kinds = np.bincount(inverse, minlength=len(head))
            if k == 1:
                lower = np.full(len(n), 1.0 / (len(n) + 1))
                self.unknown = discount * kinds[0] / total[0] / (len(n) + 1)
            else:
                rest = _row_hash(points[:, 1:])
                keys, values = below
                lower = values[np.searchsorted(keys, rest)]
            p = (n - discount) / total[inverse] + discount * kinds[inverse] / total[inverse] * lower
            h = _row_hash(points)
            o = np.argsort(h)
            below = (h[o], p[o])
            self.tables[k] = (h[o], np.log2(p[o]).astype(np.float32))
            if k > 1:
                hh = _row_hash(head)
                o = np.argsort(hh)
                self.weights[k] = (hh[o], np.log2(discount * kinds[o] / total[o]).astype(np.float32))
        self.unknown = float(np.log2(self.unknown))

    def score(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """log2 probability of the character at each position, given the hashes of all orders."""
        out = np.zeros(len(at), np.float64)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            keys, values = self.tables[k]
            found, i = _look(keys, hashes[k][at[left]])
            out[left[found]] += values[i[found]]
            left = left[~found]
            if not len(left):
                return out
            if k > 1:
                heads, weight = self.weights[k]
                found, i = _look(heads, hashes[k - 1][at[left] - 1])
                out[left[found]] += weight[i[found]]
        out[left] += self.unknown
        return out


def _row_hash(points: np.ndarray) -> np.ndarray:
    out = np.full(len(points), points.shape[1], np.uint64)
    for j in range(points.shape[1]):
        out = mix(out * _STEP + points[:, j].astype(np.uint64) + np.uint64(1))
    return out


def _look(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[i] == x, i


class Identifier:
    """Models of all languages with their calibration; picklable, and keeps word scores in the worker."""

    def __init__(self, models: dict[str, KneserNey], spread: dict[str, tuple[float, float]] | None = None):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.spread = spread or {}
        self._clear()

    def _clear(self):
        self.index, self.rows, self.size = {}, np.zeros((0, len(self.names))), np.zeros(0, np.int64)

    def __getstate__(self):
        return {"names": self.names, "models": self.models, "spread": self.spread}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.names)))
        points, off = _points(words)
        hashes = [None] + [_hashes(points, k) for k in range(1, ORDER + 1)]
        inside = np.ones(len(points), bool)
        for j in range(ORDER - 1):
            inside[off[:-1] + j] = False
        at = np.flatnonzero(inside)
        begin = off[:-1] - np.arange(len(words)) * (ORDER - 1)
        for k, m in enumerate(self.models):
            out[:, k] = np.add.reduceat(m.score(hashes, at), begin)
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool, float]]:
        """(language, score, rejected, cross-entropy) of each text."""
        if not self.names:
            return [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        out: list = []
        flat: list[int] = []
        number: list[int] = []
        for t in texts:
            ws = words_of(t)
            number.append(len(ws))
            new = [w for w in dict.fromkeys(ws) if w not in self.index]
            if new:
                base = len(self.index)
                self.index.update(zip(new, range(base, base + len(new))))
                self._fresh = getattr(self, "_fresh", [])
                self._fresh.extend(new)
            get = self.index
            flat.extend([get[w] for w in ws])
        if getattr(self, "_fresh", None):
            for i in range(0, len(self._fresh), 20_000):
                part = self._fresh[i : i + 20_000]
                self.rows = np.concatenate([self.rows, self.word_scores(part)])
                self.size = np.concatenate([self.size, np.fromiter(map(len, part), np.int64, len(part)) + 1])
            self._fresh = []
        ids, start = np.array(flat, np.int64), np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
        sums = np.zeros((len(texts), len(self.names)))
        chars = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(np.diff(start))
        if len(some):
            chars[some] = np.add.reduceat(self.size[ids], start[some])
            for k in range(len(self.names)):
                sums[some, k] = np.add.reduceat(self.rows[ids, k], start[some])
        for i in range(len(texts)):
            if not chars[i]:
                out.append((UNKNOWN, 0.0, True, 0.0))
                continue
            entropy = -sums[i] / chars[i]
            best = int(entropy.argmin())
            gaps = np.minimum((entropy - entropy[best]) * min(chars[i], 200), 500)
            score = float(1 / np.exp2(-gaps).sum())
            name = self.names[best]
            mean, deviation = self.spread.get(name, (0.0, 0.0))
            over = entropy[best] - mean
            rejected = deviation > 0 and over > REJECT_BITS and over * np.sqrt(chars[i]) > REJECT_AT * deviation
            out.append((name, score, bool(rejected), float(entropy[best])))
        if len(self.index) > KEPT:
            self._clear()
        return out


def train(docs: DataFrame, calibration: int = CALIBRATION) -> Identifier:
    """Models from rows of (doc_id, text, lang); rows of null text or lang are left out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    # about one in so many rows of a language calibrates, so that a rare one has its share however many rows others have
    each = max(1, calibration // max(1, len(number)))
    every_th = F.create_map(*(F.lit(x) for lang, n in number.items() for x in (lang, max(8, -(-n // each)))))[F.col("lang")] if number else F.lit(8)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), every_th) == 0
    def build(table: pa.Table) -> pa.Table:
        model = KneserNey("".join("".join(c.to_pylist()) for c in table.column("gram").chunks), table.column("n").to_numpy())
        name = table.column("lang")[0].as_py()
        release()
        return pa.table({"lang": pa.array([name], pa.string()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    grams = gram_counts(rows.where(~apart | F.col("doc_id").isNull()))
    # all n-grams of a language meet in one task; only the finished arrays come to the driver
    models = {r["lang"]: pickle.loads(r["model"]) for r in grams.groupBy("lang").applyInArrow(build, "lang string, model binary").collect()}
    found = Identifier(models)
    if models:
        told = identify(rows.where(apart), found, keep=("lang",)).where("lid_lang = lang AND lid_chars > 0")
        # of a text of n characters, the cross-entropy's deviation goes with 1 / sqrt(n)
        means = told.groupBy("lang").agg((F.sum(F.col("lid_entropy") * F.col("lid_chars")) / F.sum("lid_chars")).alias("mean"))
        spread = told.join(F.broadcast(means), "lang").groupBy("lang", "mean").agg(F.sqrt(F.avg((F.col("lid_entropy") - F.col("mean")) ** 2 * F.col("lid_chars"))).alias("deviation"))
        found.spread = {r["lang"]: (float(r["mean"]), float(r["deviation"])) for r in spread.collect()}
    return found


def identify(docs: DataFrame, identifier: Identifier, keep: tuple | None = None) -> DataFrame:
    """docs with lid_lang, lid_score, lid_rejected, lid_entropy (bits a character) and lid_chars."""
    spark = docs.sparkSession
    bounded_batches(spark)
    added = [("lid_lang", pa.string(), T.StringType()), ("lid_score", pa.float64(), T.DoubleType()), ("lid_rejected", pa.bool_(), T.BooleanType()), ("lid_entropy", pa.float64(), T.DoubleType()), ("lid_chars", pa.int64(), T.LongType())]
    names = list(docs.columns if keep is None else keep)
    taken = {a[0] for a in added}
    names = [n for n in names if n.lower() not in taken]
    shared = spark.sparkContext.broadcast(identifier)

    def run(batches):
        found = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            told = []
            for i in range(0, len(texts), 500):
                told += found.judge(texts[i : i + 500])
            cols = [pa.array([x[k] for x in told], kind) for k, (_, kind, _) in enumerate(added[:4])]
            cols.append(pa.array([len(t or "") for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols], names=[*names, *(a[0] for a in added)])

    fields = [docs.schema[n] for n in names] + [T.StructField(n, k) for n, _, k in added]
    return docs.mapInArrow(frugal(run), T.StructType(fields))


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), known, keep=("doc_id",))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_rejected").alias("rejected"))


SQL: dict[str, str] = {}
QUERIES = {"op6_language": op6_language}

"""Token counts by prefix dynamic programming over a byte-fallback BPE vocabulary (a sentencepiece model).

A piece never holds a blank after another character, so a text falls into words, each with the blank before it, that are encoded
independently; a word falls into parts wherever two neighbouring characters stand together in no piece. Inside a part the token
count of every prefix follows by dynamic programming: a piece ends at position i if it stands in the vocabulary and no merge
would join it with the last piece of the prefix before it; exactly one piece satisfies that, and count[i] = count[i - len(piece)] + 1.
All new words of a batch advance together, position by position, in NumPy. Counts of parts add up, so the count at every prefix of a text is
at hand without encoding anything again. Runs of blanks merge last, from the left, and take the word's own blank along if its first piece is
that blank alone. Totals of short words are kept in a bounded table in each worker, since words recur.

Whether a merge joins two pieces follows from their last merges alone: before the later one of the two was made, the half of it that touches the other
stood there; if that half and the other make a piece of a better rank, that merge came first.

Defined cases: null and empty texts have 0 tokens; any length of text is processed whole (memory follows the longest part that no cut
falls into); repeated rows are counted alike; an empty table gives no rows; further columns pass through, but for those named like an
added one, which it replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import attached, bounded_batches, frugal, read, without

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Entries after which a worker's table of words starts anew, and the characters of the longest words in it.
KEPT, KEPT_CHARS = 600_000, 48
#: Characters that one NumPy pass takes, parts beyond which positions are walked one by one, and slots of the table of pairs.
PASS, LONG_PART, PAIR_BITS = 1 << 18, 256, 20
BLANK = "▁"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Distinct non-negative keys to numbers, by open addressing; lookups of whole arrays."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1), np.full(1 << bits, -1)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            found = there == keys[left]
            out[left[found]] = self.values[slot[left[found]]]
            left = left[~found & (there >= 0)]
        return out


class PrefixCounter:
    """Exact token counts of every prefix of words and texts under one model."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {lib.id_to_piece(i): -lib.get_score(i) for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        # a character that only stands inside of pieces is spelt in bytes where nothing joins it
        self.spelt = {c for p in self.rank for c in p} - self.rank.keys()
        self.rank |= dict.fromkeys(self.spelt, -1.0)
        blanks = {len(p) for p in self.rank if set(p) == {BLANK}}
        of_blanks = {self.rank[BLANK * n] for n in blanks if n > 1}
        others = [r for p, r in self.rank.items() if len(p) > 1 and p.strip(BLANK)]
        if any(BLANK in p[1:] and p.strip(BLANK) for p in self.rank) or len(of_blanks) > 1 or of_blanks and min(of_blanks) <= max(others):
            raise ValueError("not a model whose blanks begin words and merge last")
        self.blanks = blanks | {1}
        self.kept, self.known, self.lone, self.followed, self.runs_of_blanks = kept, {}, set(), {}, [0]
        self._stack: list[int] = []
        self._tables()

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string: join the best pair, leftmost first, until no pair is a piece."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Also the two parts that were joined last."""
        parts, rank, joined = list(text), self.rank, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            joined = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, joined

    def follows(self, a: str, b: str) -> bool:
        """Whether a then b is how their concatenation is encoded."""
        got = self.followed.get((a, b))
        if got is None:
            if len(self.followed) >= self.kept:
                self.followed.clear()
            got = self.followed[a, b] = self.merged(a + b) == [a, b]
        return got

    def _tables(self):
        """Numbers of pieces in order of rank, their halves, what two of them make, and the tree of their characters."""
        halves, pieces = {}, []
        for p in sorted(self.rank, key=lambda p: (len(p) > 1, self.rank[p], p)):
            if len(p) > 1 and not p.strip(BLANK):
                continue  # runs of blanks have their own rule
            whole, joined = self._merged(p)
            if len(whole) == 1:  # a piece that its own merges don't make never occurs
                pieces.append(p)
                halves[p] = joined
        self.pieces, number = pieces, {p: i for i, p in enumerate(pieces)}
        n = len(pieces)
        self.left, self.right = np.arange(n), np.arange(n)
        for p, joined in halves.items():
            if joined:
                self.left[number[p]], self.right[number[p]] = (number[x] for x in joined)
        later = np.maximum(self.left, self.right) > np.arange(n)
        if later.any():
            raise ValueError("not a model whose pieces rank after their parts")
        self.cost = np.array([len(p.encode()) if p in self.spelt else 1 for p in pieces])
        pairs = [(number[p[:k]] * n + number[p[k:]], i) for i, p in enumerate(pieces) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.made = Table([k for k, _ in pairs], [i for _, i in pairs])
        chars = sorted({c for p in pieces for c in p})
        self.classes = len(chars) + 1
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, self.classes)
        kind = {c: k for k, c in enumerate(chars, 1)}
        self.joins = np.unique([kind[a] * self.classes + kind[b] for p in pieces for a, b in zip(p, p[1:])])
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                at = nodes.setdefault((at, kind[c]), len(nodes) + 1)
            ends[at] = i
        self.steps = Table([a * self.classes + c for a, c in nodes], list(nodes.values()))
        self.ends = np.full(len(nodes) + 1, -1)
        self.ends[list(ends)] = list(ends.values())
        self.goes_on = np.zeros(len(nodes) + 1, bool)
        self.goes_on[[a for a, _ in nodes]] = True
        self.blank = number[BLANK]
        self._pair_keys, self._pair_hold = np.full(1 << PAIR_BITS, -1), np.zeros(1 << PAIR_BITS, bool)

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a, for whole arrays: halves are taken back in order of their ranks."""
        n = len(self.pieces)
        out = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), n)
        while len(at):
            made = self.made.get(a * n + b)
            crossed = (made >= 0) & (made < limit)
            out[at[crossed]] = False
            # the later one is taken back; where it is one character, the other one
            first = ((a > b) & (self.right[a] != a)) | (self.left[b] == b)
            done = crossed | ((self.right[a] == a) & (self.left[b] == b))
            # an equal merge further left goes first: one that made b comes after the crossing one
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            on = ~done
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return out

    def _hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """pairs_hold through a table of pairs seen before; a pair takes the place of another one in its slot."""
        key = a * len(self.pieces) + b
        slot = ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self._pair_hold[slot]
        new = np.flatnonzero(self._pair_keys[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            held = self.pairs_hold(a[first], b[first])
            self._pair_keys[slot[first]], self._pair_hold[slot[first]] = key[first], held
            out[new] = held[back.ravel()]
        return out

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words with a blank before each: the offset of each, and at each character the tokens up to it and whether the first one is the blank alone."""
        points = np.frombuffer("".join(BLANK + w for w in words).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        off = np.concatenate([[0], np.cumsum(size)])
        kind = self.class_of[points]
        key = kind[:-1].astype(np.int64) * self.classes + kind[1:]
        spot = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        begins = np.ones(len(points), bool)
        begins[1:] = self.joins[spot] != key
        begins[off[:-1]] = True
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(points))
        count, lone = np.zeros(len(points), np.int64), np.zeros(len(points), bool)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PASS, "right")) - 1)
            a, z = bounds[i], bounds[j]
            self._pass(points[a:z], kind[a:z], bounds[i : j + 1] - a, count[a:z], lone[a:z])
            i = j
        # parts of a word add up, and the first part tells whether its blank is alone
        part = np.cumsum(begins) - 1
        totals = count[bounds[1:] - 1]
        before = np.cumsum(totals) - totals
        head = part[off[:-1]]
        word = np.repeat(np.arange(len(words)), size)
        count += before[part] - before[head][word]
        later = part != head[word]
        lone[later] = lone[bounds[head + 1] - 1][word[later]]
        return off, count, lone

    def _pass(self, points, kind, bounds, count, lone):
        """Fill count and lone of the parts between bounds."""
        n, size = len(points), np.diff(bounds)
        begin, end = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
        # pieces by their first and last position: all positions walk down the tree together
        at, node = np.arange(n), np.zeros(n, np.int64)
        found: list = []
        length = 0
        while len(at):
            node = self.steps.get(node * self.classes + kind[at + length])
            ok = node > 0
            at, node = at[ok], node[ok]
            whole = self.ends[node] >= 0
            found.append((at[whole], at[whole] + length, self.ends[node[whole]]))
            length += 1
            on = self.goes_on[node] & (at + length < end[at])
            at, node = at[on], node[on]
        first, last, piece = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        strange = np.flatnonzero(kind == 0)
        if len(strange):
            p = points[strange]
            count[strange] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        ended = np.full(n, -1)
        long = size > LONG_PART
        if long.any():
            of_long = np.repeat(long, size)
            for k in np.flatnonzero(long).tolist():
                self._walk(int(bounds[k]), first, last, piece, int(bounds[k + 1]), count, lone)
            keep = ~of_long[first]
            first, last, piece = first[keep], last[keep], piece[keep]
        step = last - begin[last]
        order = np.argsort(step.astype(np.uint16), kind="stable")
        first, last, piece = first[order], last[order], piece[order]
        heads = first == begin[first]
        cuts = np.flatnonzero(np.append(True, np.diff(step[order]) != 0)).tolist() + [len(order)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            f, e, p, h = first[a:z], last[a:z], piece[a:z], heads[a:z]
            before = np.where(h, f, f - 1)
            prior = ended[before]
            good = h.copy()
            check = np.flatnonzero(~h & (prior >= 0))
            good[check] = self._hold(prior[check], p[check])
            f, e, p, h, before = f[good], e[good], p[good], h[good], before[good]
            ended[e] = p
            count[e] = np.where(h, 0, count[before]) + self.cost[p]
            lone[e] = np.where(h, p == self.blank, lone[before])

    def _walk(self, a: int, first, last, piece, z: int, count, lone):
        """One long part, position by position."""
        mine = (first >= a) & (last < z)
        order = np.argsort(last[mine], kind="stable")
        ended: dict[int, str] = {}
        names, cost = self.pieces, self.cost
        done = total = -1
        counts, alone = [0] * (z - a), [False] * (z - a)
        for f, e, p in zip(first[mine][order].tolist(), last[mine][order].tolist(), piece[mine][order].tolist()):
            if e == done:
                continue
            if f == a or self.follows(ended[f - 1 - a], names[p]):
                counts[e - a] = (counts[f - 1 - a] if f > a else 0) + int(cost[p])
                alone[e - a] = alone[f - 1 - a] if f > a else p == self.blank
                ended[e - a], done = names[p], e
        count[a:z], lone[a:z] = counts, alone

    def blank_run(self, n: int) -> int:
        """Tokens of n blanks: from the left, each joins what stands before it as long as that is a piece."""
        while len(self.runs_of_blanks) <= n:
            self._stack.append(1)
            while len(self._stack) > 1 and self._stack[-2] + self._stack[-1] in self.blanks:
                self._stack[-2:] = [self._stack[-2] + self._stack[-1]]
            if len(self._stack) > 2:  # what is left of the last two is settled
                self._settled = getattr(self, "_settled", 0) + len(self._stack) - 2
                del self._stack[:-2]
            self.runs_of_blanks.append(getattr(self, "_settled", 0) + len(self._stack))
        return self.runs_of_blanks[n]

    def learn(self, words: set[str]) -> dict[str, int]:
        """Totals of words that the table doesn't hold; short ones are kept in it."""
        new = sorted(words, key=len)
        out: dict[str, int] = {}
        i = 0
        while i < len(new):
            j, chars = i, 0
            while j < len(new) and (j == i or chars + len(new[j]) < PASS) and j - i < 50_000:
                chars += len(new[j]) + 1
                j += 1
            off, count, lone = self.solve(new[i:j])
            totals, alone = count[off[1:] - 1].tolist(), np.flatnonzero(lone[off[1:] - 1]).tolist()
            out.update(zip(new[i:j], totals))
            self.lone.update(new[i + k] for k in alone)
            i = j
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        out, i = [], 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j]) <= 4 * PASS):
                chars += len(texts[j])
                j += 1
            out += self._counts(texts[i:j])
            i = j
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        split = [(t.replace(BLANK, " ") if BLANK in t else t).split(" ") for t in texts]
        new: set[str] = set()
        for ws in split:
            new.update(ws)
        new.difference_update(self.known)
        new.discard("")
        fresh = self.learn(new) if new else {}
        if len(self.known) + len(fresh) > self.kept:
            # what this batch needs stays
            self.known = {w: self.known[w] for ws in split for w in ws if w in self.known}
            self.lone.intersection_update(self.known.keys() | fresh.keys())
        self.known |= fresh
        self.known[""] = 0
        get = self.known.__getitem__
        out = []
        for t, ws in zip(texts, split):
            n = sum(map(get, ws)) if t else 0
            if t and "" in ws:
                n += self._blanks(ws)
            out.append(n)
        for w in fresh:
            if len(w) > KEPT_CHARS:
                del self.known[w]
                self.lone.discard(w)
        return out

    def _blanks(self, ws: list[str]) -> int:
        """Tokens of runs of blanks, where empty words stand for blanks that another one follows."""
        n = run = 0
        for w in ws:
            if not w:
                run += 1
            elif run:
                n += self.blank_run(run + 1) - 1 if w in self.lone else self.blank_run(run)
                run = 0
        return n + self.blank_run(run)

    def count(self, text: str) -> int:
        return self._counts([text])[0]

    def prefixes(self, text: str) -> "Prefixes":
        return Prefixes(self, text)


class Prefixes:
    """Exact token counts at every prefix of a text (in code points)."""

    def __init__(self, counter: PrefixCounter, text: str):
        words = text.replace(BLANK, " ").split(" ") if text else []
        some = list(dict.fromkeys(w for w in words if w))
        off, count, lone = counter.solve(some) if some else [np.zeros(1, np.int64)] * 3
        at = {w: k for k, w in enumerate(some)}
        out: list[np.ndarray] = []
        base = run = 0
        for w in words:
            # after the blank before the word, then after each of its characters
            out.append(np.array([base + counter.blank_run(run + 1)]))
            if not w:
                run += 1
                continue
            a, z = off[at[w]] + 1, off[at[w] + 1]
            joined, apart = counter.blank_run(run + 1) - 1, counter.blank_run(run)
            out.append(base + count[a:z] + np.where(lone[a:z], joined, apart))
            base, run = int(out[-1][-1]), 0
        self.counts = np.concatenate(out) if out else np.zeros(1, np.int64)
        self.counts[0] = 0  # the blank before the first word is the library's own

    def at(self, length: int) -> int:
        return int(self.counts[length])

    def within(self, budget: int) -> int:
        """The longest prefix of at most `budget` tokens. Counts can fall as a prefix grows, so the last one counts."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process and model."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, cut: bool = False) -> DataFrame:
    """docs with tok_bytes, tok_count, tok_over and, with `cut`, tok_cut: the longest prefix (code points) within the limit.
    `path` names the model on the executors, where the tokenizer package is installed. Input columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    path = path or model_path()
    added = [("tok_bytes", pa.int64()), ("tok_count", pa.int64()), ("tok_over", pa.bool_())] + [("tok_cut", pa.int64())] * cut
    docs = without(docs, *(n for n, _ in added))

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = c.counts(texts)
            cols = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            if cut:
                cols.append(pa.array([len(t) if x <= limit else c.prefixes(t).within(limit) for t, x in zip(texts, n)], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(x for x, _ in added)])

    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType()}
    return docs.mapInArrow(frugal(run), attached(docs, [(n, kinds[k]) for n, k in added]))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "tok_bytes n_bytes", "tok_count n_tokens", "tok_over over_limit")


SQL: dict[str, str] = {}
QUERIES = {"op9_tokens": op9_tokens}

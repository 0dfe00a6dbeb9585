"""Plain restatements of the operators, for small inputs."""

import hashlib
import re
from itertools import combinations

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed_spans(rows, size=50):
    """[(doc_id, text)] -> [(bytes, spans)]: bytes of strings that also start in a document with a smaller id (null is the largest)."""
    big = 1 << 63
    first = {}
    for i, t in rows:
        x = (t or "").encode()
        for k in range(len(x) - size + 1):
            w = x[k : k + size]
            first[w] = min(first.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        x = (t or "").encode()
        hit = bytearray(len(x))
        for k in range(len(x) - size + 1):
            if first[x[k : k + size]] < (big if i is None else i):
                hit[k : k + size] = b"\1" * size
        out.append((x, [m.span() for m in re.finditer(b"\1+", bytes(hit))]))
    return out


def kept_digest(x, spans):
    at, kept = 0, []
    for s, e in spans:
        kept.append(x[at:s])
        at = e
    return hashlib.sha256(b"".join([*kept, x[at:]])).hexdigest()


def shingle_set(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII))
    return frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))) if w else frozenset()


def components(rows, n=3, percent=90):
    """[(doc_id, text)] -> {doc_id: (set sizes, component)}."""
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        common = len(a & b)
        if a and b and 100 * common >= percent * (len(a) + len(b) - common):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in sets)


def contamination(docs, items, window=10):
    """[(doc_id, text)] -> [(words, hit words, sorted item ids)]."""
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(ASCII))

    patterns = {}
    for name, t in items:
        w = words(t)
        if w:
            m = min(window, len(w))
            for k in range(len(w) - m + 1):
                patterns.setdefault(tuple(w[k : k + m]), set()).add("null" if name is None else str(name))
    out = []
    for _, t in docs:
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if p := patterns.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= p
        out.append((len(w), len(hit), sorted(found)))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target} by pouring out what is over a cap again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / share > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        capped |= over


def copies(rows, aims, sizes, seed, turns):
    """How often each (doc_id, size, source) is taken: floor of the rate, and once more if its place on the circle lies below the fraction after its source's turn."""
    import hashlib

    def number(name, at=0):
        return int(hashlib.md5(name.encode()).hexdigest()[at : at + 8], 16) / (1 << 32)

    def name(x):
        return "null" if x is None else str(x)

    def taken(doc_id, source, turn):
        rate = aims[source] / sizes[source] if sizes[source] else 0.0
        fraction = rate - int(rate)
        if turn is None:
            return min(int(rate) + (number(f"{name(doc_id)}:{seed}", 8) < fraction), 3)
        return min(int(rate) + ((number(f"{name(doc_id)}:{seed}") - turn / turns) % 1 < fraction), 3)

    chosen = {}
    for source in sizes:
        own = [r for r in rows if r[2] == source]
        takes = [sum(taken(r[0], source, k) * r[1] for r in own) for k in range(turns)]
        below, above = [t for t in takes if t <= aims[source]], [t for t in takes if t >= aims[source]]
        chosen[source] = None
        if below and above:
            low, high = max(below), min(above)
            up = low < high and number(f"{name(source)}:{seed}:source") < (aims[source] - low) / (high - low)
            chosen[source] = takes.index(high if up else low)
    return [taken(r[0], r[2], chosen[r[2]]) for r in rows]

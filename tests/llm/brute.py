"""Plain restatements of the operators, over Python lists."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10, log1p

import numpy as np

GAP = re.compile(rb"[\x20\x09-\x0D]+")


def lower(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words(text: str | None) -> list[bytes]:
    return [w for w in GAP.split(lower(text)) if w]


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, percent: int = 85) -> dict:
    """doc_id -> (set size, component) by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1:])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def removed_repeats(rows, span: int = 50) -> dict:
    """doc_id -> (bytes, removed, runs, sha256 of the rest) by a dictionary of all spans."""
    first: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - span + 1):
            first[b[s:s + span]] = min(i, first.get(b[s:s + span], i))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s:s + span]] < i:
                gone[s:s + span] = b"\x01" * span
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def unigram(rows) -> dict:
    """doc_id -> (held out, tokens, known, training tokens, base score)."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*words(t), None] for i, t in rows}
    counts = Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(ts), sum(counts[x] > 0 for x in ts), n, sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts))
            for i, ts in tokens.items()}


def mixed(rows) -> list[tuple[int, float]]:
    """(doc_id, log10 probability) by a plain model of one shard: counts in dictionaries, one bit of one event after the other."""
    gaps, orders, gates, cells = b" \t\n\v\f\r\0", 5, 96, 33

    def happenings(text):
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + b"\xff"
        return [(b"\0" * 5 + data)[i:i + 6] for i in range(len(data))]

    def seen_by(event):
        history = event[:5]
        word = max(i + 1 for i in range(-1, 5) if i < 0 or history[i] in gaps)
        return [(k, history[5 - k:]) for k in range(1, 6)] + [("word", history[word:])]

    def nodes(event):
        return [(event[5] >> (8 - p) if p else 0, (event[5] >> (7 - p)) & 1) for p in range(8)]

    train = Counter(e for i, t in rows if zlib.crc32(str(i).encode()) % 10 for e in happenings(t))
    table = Counter()
    for e, n in train.items():
        for c in seen_by(e):
            for p, (node, bit) in enumerate(nodes(e)):
                table[c, p, node, bit] += n
    weights = [[0.3] * 6 for _ in range(gates)]
    levels = [[1 / (1 + exp(-(-11 + 22 * j / (cells - 1)))) for j in range(cells)] for _ in range(gates)]

    def predict(e, p, own):
        node, bit = nodes(e)[p]
        pairs = [[table[c, p, node, b] - (own and b == bit) for b in (0, 1)] for c in seen_by(e)]
        longest = max([k + 1 for k in range(orders) if sum(pairs[k])], default=0)
        gate = (p * (orders + 1) + longest) * 2 + (sum(pairs[5]) > 0)
        x = [log((one + 0.4) / (zero + 0.4)) for zero, one in pairs]
        z = min(max(sum(a * b for a, b in zip(x, weights[gate])), -11), 11)
        return gate, x, 1 / (1 + exp(-z)), round((z + 11) * (cells - 1) / 22), bit

    known = sorted(train, key=lambda e: (e[2:5], e[:2], e[5]))
    order = [known[i] for i in np.random.default_rng(5).permutation(len(known))] if known else []
    for a in range(0, len(order), 1024):
        for p in range(8):
            step = [(train[e], *predict(e, p, True)) for e in order[a:a + 1024]]
            for gate in {s[1] for s in step}:
                of = [s for s in step if s[1] == gate]
                for k in range(6):
                    weights[gate][k] += 0.5 * sum(n * (bit - q) * x[k] for n, _, x, q, _, bit in of) / sum(s[0] for s in of)
                for j in {s[4] for s in of}:
                    hit = [s for s in of if s[4] == j]
                    n = sum(s[0] for s in hit)
                    levels[gate][j] += min(0.02 * log1p(n), 0.5) * (sum(s[0] * s[5] for s in hit) / n - levels[gate][j])

    def bits(e):
        total = 0.0
        for p in range(8):
            gate, _, q, j, bit = predict(e, p, False)
            one = min(max((q + levels[gate][j]) / 2, 2.0**-16), 1 - 2.0**-16)
            total += log10(one if bit else 1 - one)
        return total

    return sorted((i, sum(bits(e) for e in happenings(t))) for i, t in rows)


def targets(sizes: list[int], weights=(5, 2, 1)) -> list[float]:
    """Shares by weight, capped at three times the size, the excess shared again until none is above."""
    weight = [weights[i % 3] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        level = left / sum(weight[i] for i in open_)
        capped = [i for i in open_ if level * weight[i] > 3 * sizes[i]]
        if not capped:
            for i in open_:
                out[i] = level * weight[i]
            break
        for i in capped:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
            open_.discard(i)
    return out


def top_k(rows, k: int = 20) -> list:
    """(query id, rank, vec_id, score) by all pairs of rows (id, vector)."""
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (width - len(v))) for i, v in good]
    out = []
    for own, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for n, (i, y) in enumerate(good) if n != own)[:k]
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    return sorted(out)


def best_fit(counts: dict[int, int], capacity: int) -> int:
    """Number of bins of best-fit decreasing, one piece at a time."""
    free: list[int] = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fitting = [(f, n) for n, f in enumerate(free) if f >= size]
            if fitting:
                free[min(fitting)[1]] -= size
            else:
                free.append(capacity - size)
    return len(free)

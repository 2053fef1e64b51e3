"""Plain Python versions of the training-text operators."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def jaccard(rows, size, percent):
    rows = sorted(rows)
    sets = [shingle_set(t, size) for _, t in rows]
    linked = [(i, j) for i in range(len(sets)) for j in range(i)
              if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return {rows[i][0]: (len(sets[i]), rows[g][0]) for i, g in enumerate(groups(len(rows), linked))}


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone, end = bytearray(len(raw)), 0
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                for q in range(max(p, end), p + length):
                    gone[q] = 1
                end = p + length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for q in range(len(raw)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def lines(rows, percent=80):
    sizes, where, out = [], defaultdict(list), {}
    for i, t in sorted(rows):
        n, gone = 0, []
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = WORD.findall(line.lower())
            if not w:
                continue
            n += 1
            own = {tuple(w)} if len(w) < 5 else {tuple(w[j:j + 5]) for j in range(len(w) - 4)}
            met = Counter(j for g in own for j in where[g])
            if any(100 * c >= percent * (len(own) + sizes[j] - c) for j, c in met.items()):
                gone.append(k)
            for g in own:
                where[g].append(len(sizes))
            sizes.append(len(own))
        out[i] = (n, len(gone), gone)
    return out


def quality(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    mark = [0] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            mark[i:i + 8] = [1] * 8
    found = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(found) - len(set(found)), sum(mark))


def kneser_ney(train, texts, discounts):
    split = lambda t: WORD.findall((t or "").translate(LOWER)) + ["\0end"]
    train = [split(t) for t in train]
    c = Counter(w for t in train for w in t)
    total, v = sum(c.values()), len(c)
    grams = Counter(g for t in train for g in zip(["\0begin", *t], t))
    ctx, before = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), n in grams.items():
        ctx[u][0] += n
        ctx[u][min(n, 3)] += 1
        before[w] += 1
    many, few = Counter(grams.values()), Counter(before.values())
    d, low = discounts(*(many[k] for k in (1, 2, 3, 4))), discounts(*(few[k] for k in (1, 2, 3, 4)))
    types = len(grams)
    free = (low[0] * few[1] + low[1] * few[2] + low[2] * sum(n for k, n in few.items() if k > 2)) / types if types else 1

    def p(u, w):
        k = before[w]
        lower = (max(k - low[min(k, 3) - 1], 0) / types if k else 0) + free / (v + 1)
        if u not in ctx:
            return lower
        x, k = ctx[u], grams[u, w]
        return (max(k - d[min(k, 3) - 1], 0) / x[0] if k else 0) + (d[0] * x[1] + d[1] * x[2] + d[2] * x[3]) / x[0] * lower

    out = []
    for t in map(split, texts):
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t)
        out.append((len(t), sum(c[w] > 0 for w in t), total, base, sum(math.log10(p(u, w)) for u, w in zip(["\0begin", *t], t))))
    return out, p, c

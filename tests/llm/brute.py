"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def groups(docs):
    """{id: (set size, least id reachable)} of (id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    shared, by = defaultdict(int), defaultdict(list)
    for d, s in sets.items():
        for g in s:
            for other in by[g]:
                shared[other, d] += 1
            by[g].append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), c in shared.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def dedup_lines(docs, words=50):
    """{id: text} with every line cut that lies in a run of over `words` words that also begins earlier."""
    docs = sorted(docs)
    seen, out = {}, {}
    lines = {d: [(i, x, len(WORD.findall(x))) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in docs if t is not None}
    runs = []
    for d, own in lines.items():
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += own[b][2]
                if total > words:
                    runs.append((d, own[a][0], own[b][0], tuple(x[1] for x in own[a : b + 1])))
    for d, a, _, content in runs:
        seen[content] = min(seen.get(content, (d, a)), (d, a))
    gone = defaultdict(set)
    for d, a, b, content in runs:
        if seen[content] != (d, a):
            gone[d].update(range(a, b + 1))
    for d, t in docs:
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
    return out


def edit_to_any_run(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(row[j] + (v != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def held(docs, items):
    """{(doc, item): distance} of the items that a text holds."""
    words = lambda t: [w.translate(LOWER) for w in ALNUM.findall(t or "")]
    out = {}
    for i, t in items:
        item = words(t)
        k = len(item) // 5 if len(item) >= 6 else 0
        if not item:
            continue
        for d, text in docs:
            x = words(text)
            if len(set(item) - set(x)) <= k:
                e = edit_to_any_run(item, x)
                if e <= k:
                    out[d, i] = e
    return out


def token_pieces(docs, tokenizer, capacity=4096):
    for d, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            yield d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


class KneserNey:
    """Interpolated Kneser-Ney over characters by dictionaries: one discount for each order, even noise below the unigrams."""

    def __init__(self, texts, alphabet, order):
        self.order, self.alphabet = order, len(alphabet | {" "}) + 1
        self.counts = [defaultdict(int) for _ in range(order + 1)]
        for t in texts:
            s = " " * (order - 1) + t
            for i in range(len(s) - order + 1):
                self.counts[order][s[i : i + order]] += 1
        for k in range(order - 1, 0, -1):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        ones = lambda c, n: sum(v == n for v in c.values())
        self.discounts = [0.0] + [ones(c, 1) / (ones(c, 1) + 2 * ones(c, 2)) if ones(c, 1) and ones(c, 2) else 0.5 for c in self.counts[1:]]

    def p(self, gram):
        if not gram:
            return 1 / self.alphabet
        c, d = self.counts[len(gram)], self.discounts[len(gram)]
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return self.p(gram[1:])
        return (max(c.get(gram, 0) - d, 0) + d * len(own) * self.p(gram[1:])) / sum(own.values())

    def entropy(self, text):
        s = " " * (self.order - 1) + text
        return -sum(np.log(self.p(s[i : i + self.order])) for i in range(len(s) - self.order + 1)) / len(text)


MASK = (1 << 64) - 1


def mix64(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def quality_score(text, weight, bias, grams, bits):
    k, found = 0x9E3779B97F4A7C15, []
    for w in WORD.findall(text.translate(LOWER)):
        b = w.encode()
        h = sum((x + 1) * pow(k, i, 1 << 64) for i, x in enumerate(b)) + len(b) * 0xC2B2AE3D27D4EB4F
        found.append(mix64(h & MASK) * k & MASK)
    points = [ord(c) + 1 for c in text]
    for n in grams:
        for i in range(len(points) - n + 1):
            h = points[i] * k & MASK
            for x in points[i + 1 : i + n]:
                h = (h ^ x) * k & MASK
            found.append(h)
    mean = sum(float(weight[h >> (64 - bits)]) for h in found) / max(1, len(found))
    return 1 / (1 + np.exp(-(mean + bias)))

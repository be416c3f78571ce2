"""Plain re-implementations that the llm operators are held against."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def discounts(n, k=5):
    out = {}
    for r in range(1, k + 1):
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        d = 1.0
        if common < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] else 1.0
        if not 0 < d < 1:
            d = (r - (n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5)) / r
        out[r] = d
    return out


class Katz:
    """A bigram model over lists of (text, is it trained on)."""

    def __init__(self, texts, k=5):
        uni, bi = Counter(), Counter()
        for t in texts:
            words = ["<s>", *WORD.findall(lower(t)), "</s>"]
            uni.update(words[1:])
            bi.update(zip(words, words[1:]))
        self.uni, self.bi, self.n, self.v = uni, bi, sum(uni.values()), len(uni)
        d1, d2 = (discounts(Counter(c.values()), k) for c in (uni, bi))
        saved = sum((1 - d1.get(c, 1)) * c for c in uni.values())
        whole = self.n if saved > 0 else self.n + 1
        self.low = {w: d1.get(c, 1) * c / whole for w, c in uni.items()}
        self.unk = (saved if saved > 0 else 1) / whole
        self.high, self.alpha = {}, {}
        by = defaultdict(dict)
        for (h, w), c in bi.items():
            by[h][w] = c
        for h, seen in by.items():
            total, kept = sum(seen.values()), sum(d2.get(c, 1) * c for c in seen.values())
            whole = total if total - kept > 1e-9 * total else total + 1
            for w, c in seen.items():
                self.high[h, w] = d2.get(c, 1) * c / whole
            self.alpha[h] = (1 - kept / whole) / (1 - sum(self.low[w] for w in seen))

    def p(self, w, h):
        if (h, w) in self.high:
            return self.high[h, w]
        return self.alpha.get(h, 1.0) * self.low.get(w, self.unk)

    def score(self, text):
        words = ["<s>", *WORD.findall(lower(text)), "</s>"]
        base = sum(math.log10((self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in words[1:])
        return len(words) - 1, sum(self.uni[w] > 0 for w in words[1:]), base, sum(math.log10(self.p(w, h)) for h, w in zip(words, words[1:]))


def near_groups(rows, size, percent=80):
    """{id: (set size, smallest id of the component)}."""
    sets = {}
    for i, t in rows:
        x = WORD.findall(lower(t))
        n = min(size, len(x))
        sets[i] = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if x else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    having = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            having[h].append(i)
    for i, s in sets.items():
        common = Counter(j for h in s for j in having[h] if j < i)
        for j, v in common.items():
            if 100 * v >= percent * (len(s) + len(sets[j]) - v):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edit_occurrence(pattern, text):
    """The smallest edit distance of the pattern to any part of the text."""
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        cur = [i]
        for j, x in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
        prev = cur
    return min(prev)


def repeated_bytes(rows, length=400):
    """{id: (bytes, removed, runs, kept bytes)} of (id, text) rows."""
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for a in range(len(b) - length + 1):
            seen[b[a : a + length]] += 1
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if seen[b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def repair(rows):
    """Turns (turn, role, text) of one conversation, in order, by trying all edits turn by turn: (blank, duplicate, truncated, illegal, cost, audit, repaired)."""
    kinds, seen = [], set()
    for _, role, text in rows:
        if not WORD.search(text):
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("truncated" if text.rstrip(" \t\n\x0b\f\r")[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    grammar = re.compile(r"(s?(ua)+)?")
    start = re.compile(r"(s?(ua)*u?)?")
    paths = [(0, "", "", ())]
    for kind, (_, role, text), initial in zip(kinds, rows, initials):
        grown = []
        for cost, audit, read, out in inserted(paths, start):
            grown.append((cost + 3, audit + "D", read, out))
            if kind in ("", "truncated"):
                more = kind == "truncated"
                grown.append((cost + more, audit + "K", read + initial if initial else read + "?", (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    grown.append((cost + 2 + more, audit + "R", read + r[0], (*out, f"{r}:{text}")))
        paths = pruned(p for p in grown if start.fullmatch(p[2]))
    ends = [p for p in inserted(paths, start) if grammar.fullmatch(p[2])]
    cost, audit, _, out = min(ends, key=lambda p: p[:2])
    return kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, "\n".join(out)


def inserted(paths, start):
    """The paths with up to three more inserted turns."""
    every = list(paths)
    for _ in range(3):
        paths = [(c + 2, a + "I", read + r[0], (*out, f"{r}:")) for c, a, read, out in paths for r in ("user", "assistant") if start.fullmatch(read + r[0])]
        every += paths
    return every


def pruned(paths):
    """Of paths that read the same string, the least; and none that costs 12 more than the cheapest of all."""
    best = {}
    for p in paths:
        if p[2] not in best or p[:2] < best[p[2]][:2]:
            best[p[2]] = p
    least = min(p[0] for p in best.values())
    return [p for p in best.values() if p[0] <= least + 12]

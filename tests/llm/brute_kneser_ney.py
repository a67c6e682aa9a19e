"""Interpolated modified Kneser-Ney over characters, written as in the textbook: dictionaries and recursion."""

import math
from collections import Counter, defaultdict

PAD = "\0"


class Brute:
    def __init__(self, texts, order):
        self.order = order
        top = Counter()
        for t in texts:
            t = PAD * (order - 1) + " ".join(t.split())
            top.update(t[i:i + order] for i in range(len(t) - order + 1))
        self.c = {order: dict(top)}
        for n in range(order - 1, 0, -1):
            before = defaultdict(set)
            for g in self.c[n + 1]:
                before[g[1:]].add(g[0])
            self.c[n] = {g: len(s) for g, s in before.items()}
        self.d, self.total, self.left = {}, {}, {}
        for n, level in self.c.items():
            t = Counter(level.values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else None
            self.d[n] = [0] + [
                max(0.0, min(float(k), k - (k + 1) * y * t[k + 1] / t[k])) if y is not None and t[k] else 0.5 for k in (1, 2, 3)]
            total, left = defaultdict(int), defaultdict(float)
            for g, c in level.items():
                total[g[:-1]] += c
                left[g[:-1]] += self.d[n][min(c, 3)]
            self.total[n], self.left[n] = total, left

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / (len(self.c[1]) + 1)
        ctx = g[:-1]
        if ctx not in self.total[n]:
            return self.p(g[1:])
        c = self.c[n].get(g, 0)
        own = (c - self.d[n][min(c, 3)]) / self.total[n][ctx] if c else 0.0
        return own + self.left[n][ctx] / self.total[n][ctx] * self.p(g[1:])

    def logp(self, text):
        t = " ".join(text.split())
        padded = PAD * (self.order - 1) + t
        return sum(math.log(max(self.p(padded[i:i + self.order]), 1e-30)) for i in range(len(t)))

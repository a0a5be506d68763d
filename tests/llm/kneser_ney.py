"""An interpolated modified Kneser-Ney model by plain counting, as the classifier's docstrings define it."""

import math
from collections import Counter, defaultdict


class Model:
    def __init__(self, texts, order, pad="\u0002"):
        self.order, self.pad, self.levels = order, pad, {}
        counts = Counter(g for t in texts for g in self.grams(t))
        for length in range(order, 0, -1):
            self.levels[length] = counts
            counts = Counter(g[1:] for g in counts)
        self.letters = len(self.levels[1])
        self.after = {length: defaultdict(dict) for length in self.levels}
        for length, level in self.levels.items():
            for g, n in level.items():
                self.after[length][g[:-1]][g[-1]] = n
        self.cuts = {length: self.discounts(level) for length, level in self.levels.items()}

    def grams(self, text):
        text = (text or "").replace("\0", "�")
        padded = self.pad * (self.order - 1) + text
        return [padded[i : i + self.order] for i in range(len(text))]

    @staticmethod
    def discounts(level):
        n = {i: sum(c == i for c in level.values()) for i in (1, 2, 3, 4)}
        out = {}
        for i in (1, 2, 3):
            d = 0.5 * i if n[i] == 0 or n[1] + 2 * n[2] == 0 else i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i]
            out[i] = max(0.05, min(i - 0.05, d))
        return out

    def probability(self, gram):
        length = len(gram)
        if length == 0:
            return 1 / (1 + self.letters)
        seen = self.after[length].get(gram[:-1], {})
        below = self.probability(gram[1:]) if length > 1 else 1 / (1 + self.letters)
        if not seen:
            return below
        total, cut = sum(seen.values()), self.cuts[length]
        n = seen.get(gram[-1], 0)
        spared = sum(cut[min(c, 3)] for c in seen.values())
        return ((n - cut[min(n, 3)]) / total if n else 0) + spared / total * below

    def nats(self, text):
        return -sum(math.log(self.probability(g)) for g in self.grams(text))

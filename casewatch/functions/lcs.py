"""Token-sort ratio of one name against many, for use inside Arrow tasks.

The ratio is ``200 * LCS / (len1 + len2)`` over the names with their words sorted. LCS
lengths come from the published bit-parallel recurrence, run on 64-bit words for all
candidates at once; longer names take several words with a carry between them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two strings as one expression (table rows as arrays).

    Slow next to the batch form below; it needs no Python worker.
    """
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.size(chars_b)), lambda i: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        def next_cell(done: Column, j: Column) -> Column:
            up, left, corner = F.get(row, j), F.get(done, j - 1), F.get(row, j - 1)
            cell = F.when(F.get(chars_b, j - 1) == x, corner + 1).otherwise(F.greatest(up, left))
            return F.concat(done, F.array(cell))

        first = F.array(F.lit(0))
        return F.when(F.size(chars_b) == 0, first).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size(chars_b)), first, next_cell)
        )

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(
        F.element_at(F.aggregate(chars_a, start, next_row), -1)
    )


def sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


class RatioIndex:
    """Names to compare queries with: all ratios, or the best one without computing the others.

    No subsequence is longer than the characters that both names have, each counted as often as both have
    it. ``best`` computes that bound for all names, a few vector operations on small counts for every
    different character of the query, and the subsequence itself for the names in the order of
    the bound, as long as the bound reaches the best ratio so far. Nothing is lost: a name left out could not win.
    """

    def __init__(self, names: Sequence[str]):
        self.texts = [sorted_words(n) for n in names]
        n, lengths = len(self.texts), [len(t) for t in self.texts]
        self.lengths = np.array(lengths, dtype=np.int64)
        self.letters = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(self.texts))))}
        longest = max(lengths, default=0)
        self.codes = np.zeros((longest, n), dtype=np.int32)
        flat = np.fromiter((self.letters[ch] for t in self.texts for ch in t), np.int32, sum(lengths))
        who = np.repeat(np.arange(n), self.lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.codes[place, who] = flat
        held = np.bincount(flat.astype(np.int64) * n + who, minlength=(len(self.letters) + 1) * n)
        small = np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.uint32
        self.counts = held.reshape(-1, n).astype(small)
        self.sums = small  # no sum exceeds the longest name
        self.computed = 0  # subsequences computed so far

    def common(self, query: str, rows: np.ndarray | None = None) -> np.ndarray:
        """Longest common subsequences of a word-sorted query with the names, or those at ``rows``.

        The query's letters are bits of as many 64-bit words as it needs; every word takes the carry of the one before.
        """
        codes = self.codes if rows is None else self.codes[: self.lengths[rows].max(initial=0), rows]
        n, n_words = codes.shape[1], -(-len(query) // 64)
        self.computed += n
        masks = np.zeros((n_words, len(self.letters) + 1), dtype=np.uint64)
        for i, ch in enumerate(query):
            if ch in self.letters:
                masks[i // 64, self.letters[ch]] |= np.uint64(1 << i % 64)
        state = np.full((n_words, n), np.iinfo(np.uint64).max, dtype=np.uint64)
        for column in codes:
            carry = None
            for word in range(n_words):
                now, met = state[word], masks[word, column]
                met &= now
                total = now + met
                if word + 1 < n_words:
                    over = total < met
                if carry is not None:
                    total += carry
                    if word + 1 < n_words:
                        over |= total < carry
                state[word] = total | (now - met)
                if word + 1 < n_words:
                    carry = over.astype(np.uint64)
        found = np.zeros(n, dtype=np.int64)
        for word in range(n_words):
            bits = min(64, len(query) - 64 * word)
            found += np.bitwise_count(~state[word] & np.uint64((1 << bits) - 1))
        return found

    def bounds(self, query: str) -> np.ndarray:
        """Characters in common with each name, which no common subsequence exceeds."""
        most = np.zeros(len(self.texts), dtype=self.sums)
        for ch, times in Counter(query).items():
            if ch in self.letters:
                most += np.minimum(self.counts[self.letters[ch]], min(times, np.iinfo(self.counts.dtype).max))
        return most

    def ratio(self, query: str, common: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        total = (self.lengths if rows is None else self.lengths[rows]) + len(query)
        return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))

    def scores(self, query: str) -> np.ndarray:
        """The ratios of all names."""
        query = sorted_words(query)
        return self.ratio(query, self.common(query))

    def best(self, query: str, first: int = 32) -> tuple[int, float]:
        """(place, ratio) of the best name, the first of several."""
        query = sorted_words(query)
        limits = self.ratio(query, self.bounds(query))
        n = len(limits)
        head = np.argpartition(-limits, first)[:first] if n > first else np.arange(n)
        ratios = self.ratio(query, self.common(query, head), head)
        top = ratios.max()
        place = int(head[ratios == top].min())
        rest = limits >= top
        rest[head] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.argsort(-limits[rest], kind="stable")]
        size, at = 4 * first, 0
        while at < len(rest) and limits[rest[at]] >= top:
            rows = rest[at : at + size]
            ratios = self.ratio(query, self.common(query, rows), rows)
            if ratios.max() >= top:
                if ratios.max() > top:
                    top, place = ratios.max(), n
                place = min(place, int(rows[ratios == top].min()))
            at, size = at + size, 2 * size
        return place, float(top)

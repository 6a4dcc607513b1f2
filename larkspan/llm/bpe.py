"""Prefix automaton of a byte-pair vocabulary.

A sequence of tokens is what greedy merging gives for its text exactly when every two neighbours are
what merging gives for the two of them alone.  So the tokens of every prefix follow from shorter
prefixes: of the tokens that end at a position just one fits the last token of the prefix before it.
``PairRule`` decides whether two tokens fit; the callers run the dynamic programme over positions.
"""

from __future__ import annotations

INF = 1 << 60


class PairRule:
    """Whether merging leaves the border between two tokens alone.

    left and right give a token's two parts in its own merge history (None: it is a single symbol),
    rank(a, b) the priority of joining two symbols (smaller first), or None where they don't join.
    """

    def __init__(self, parts: dict, rank):
        self.parts, self.rank = parts, rank
        self.right_edges: dict = {}
        self.left_edges: dict = {}

    def _edges(self, token, side: int, cache: dict) -> list:
        """(symbol, when it came about, when it went) from the whole token inwards, along one edge."""
        found = cache.get(token)
        if found is None:
            found, gone, at = [], INF, token
            while True:
                made = self.parts.get(at)
                found.append((at, made[2] if made else -1, gone))
                if not made:
                    break
                gone, at = made[2], made[side]
            cache[token] = found
        return found

    def decide(self, a, b) -> bool:
        rank = self.rank
        for x, x_made, x_gone in self._edges(a, 1, self.right_edges):
            for y, y_made, y_gone in self._edges(b, 0, self.left_edges):
                r = rank(x, y)
                if r is not None:
                    at = max(r, x_made, y_made)
                    # equal priorities go from left to right
                    if at < x_gone and (at < y_gone or at == y_gone):
                        return False
        return True


def history(symbols: list, rank, join) -> tuple[list, dict]:
    """Greedy merging of a few symbols, smallest rank first, then leftmost; the result and each merge's parts."""
    row, parts, now = list(symbols), {}, -1
    while len(row) > 1:
        best, at = None, -1
        for i in range(len(row) - 1):
            r = rank(row[i], row[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        now = max(now, best)
        new = join(row[at], row[at + 1])
        parts[new] = (row[at], row[at + 1], now)
        row[at : at + 2] = [new]
    return row, parts

"""Prefix tables of byte-pair encodings: for each prefix of a piece the last token of its only valid encoding.

A token ends the encoding of a prefix when it is a suffix of the prefix and may follow the
last token of what stands before it.  The tokens that are suffixes come from an Aho-Corasick
automaton, which follows longest-suffix links.  Two tokens may stand side by side when
merging their symbols gives just these two: their merges are undone from the last to the
first, and at each step the symbols at the seam must not have been mergeable earlier than
the merge that was undone.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

# Bytes (as estimated) that one generation of a cache may hold.
CACHE_BYTES = 48 << 20
# Pairs of tokens that are remembered.
CACHE_PAIRS = 250_000
_NEVER = 1 << 60


class Recent(dict):
    """What a function gave for recent keys.

    A full generation becomes the old one, and what is asked for again moves to the new one;
    so frequent keys stay, and memory is bounded by two generations.
    """

    def __init__(self, fill: Callable, limit: int = CACHE_BYTES):
        super().__init__()
        self.fill, self.limit, self.size, self.old = fill, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        self.size += 200 + len(key) + 4 * len(value)
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        return value


class _Followers(dict):
    """Whether a token may follow a prefix whose last token is ``left``; -1: none, or a symbol that no token holds."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.known = merges, 0

    def __missing__(self, left: int) -> _Follower:
        row = self[left] = _Follower(self, left)
        return row


class _Follower(dict):
    def __init__(self, rows: _Followers, left: int):
        super().__init__()
        self.rows, self.left = rows, left

    def __missing__(self, token: int) -> bool:
        rows, left, merges = self.rows, self.left, self.rows.merges
        rows.known += 1
        if rows.known > CACHE_PAIRS:
            rows.clear()
            rows.known = 0
        fits = self[token] = merges.parts(token) is not None and (left < 0 or merges.joins(left, token))
        return fits


class Merges:
    """Tokens (strings of symbols) by id, and when each is merged: lower ranks first, leftmost first among equals."""

    def __init__(self, ids: dict[str, int], rank: dict[int, int] | None = None):
        self.ids = ids
        self.text = {i: t for t, i in ids.items()}
        self.rank = rank or {i: i for i in self.text}
        several = set()
        seen: dict[int, int] = {}
        for i, r in self.rank.items():
            if seen.setdefault(r, i) != i:
                several.update((i, seen[r]))
        # Tokens whose rank others share: their pairs are merged in full.
        self.tied = several
        self.size = {i: len(t) for i, t in self.text.items()}
        self.longest = max(self.size.values(), default=0)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self._parts: dict[int, tuple[int, int] | tuple[()] | None] = {}
        self._rows = _Followers(self)

    def merge(self, piece: str, until: int = 1) -> list[str]:
        """By definition: again and again join the leftmost adjacent pair of lowest rank."""
        parts = list(piece)
        while len(parts) > until:
            best, at = min((self.rank.get(self.ids.get(a + b, -1), _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens that the token is merged from; () for one symbol, None if merging never gives it."""
        if token not in self._parts:
            text = self.text[token]
            if len(text) == 1:
                got = ()
            else:
                two = self.merge(text, 2)
                got = (self.ids[two[0]], self.ids[two[1]]) if len(two) == 2 and all(t in self.ids for t in two) else None
            self._parts[token] = got
        return self._parts[token]

    def joins(self, left: int, right: int) -> bool:
        """Whether merging the symbols of both gives just the two."""
        text, ids, rank, parts = self.text, self.ids, self.rank, self.parts
        if left in self.tied or right in self.tied:
            return self.merge(text[left] + text[right]) == [text[left], text[right]]
        a, b, after_a, after_b = left, right, _NEVER, _NEVER
        while True:
            across = rank.get(ids.get(text[a] + text[b], -1), _NEVER)
            if across < after_a and across <= after_b:
                return False
            pa, pb = parts(a), parts(b)
            if pb and (not pa or rank[b] >= rank[a]):
                after_b, b = rank[b], pb[0]
            elif pa:
                after_a, a = rank[a], pa[1]
            else:
                return True

    def extend(self, piece: str, last: list[int]) -> list[int]:
        """The table of last tokens of ``piece``, given that of one of its prefixes.

        -1 marks a symbol that no token holds; it stands alone.
        """
        have = len(last)
        # Entry 0 stands for the empty prefix.
        table = [-1, *last, *[-1] * (len(piece) - have)]
        rows, done = self._rows, -1
        for end, (token, size) in self.automaton.iter(piece, max(0, have + 1 - self.longest)):
            if end != done and end >= have and rows[table[end + 1 - size]][token]:
                table[end + 1] = token
                done = end
        del table[0]
        return table

    def counts(self, piece: str) -> list[int]:
        """Numbers of tokens of all prefixes of ``piece``, from the empty one; each symbol has to be in a token."""
        table, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        rows, done = self._rows, -1
        for end, (token, size) in self.automaton.iter(piece):
            if end != done and rows[table[end + 1 - size]][token]:
                table[end + 1] = token
                counts[end + 1] = counts[end + 1 - size] + 1
                done = end
        return counts

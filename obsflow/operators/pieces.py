"""Lists held as runs of original positions, so that edits cost by their number and not by the list's length."""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

# Runs of a block before it is halved.
RUNS = 512


class PieceTable:
    """A list of (position, mark) that starts as 0..n-1 with mark 0, as blocks of runs.

    A tree of the blocks' lengths (each node sums a power of two of them) finds the block of
    an index, and the block's running lengths the run: O(log blocks + RUNS) for an edit.
    """

    def __init__(self, n: int):
        self.n = n
        self.blocks = [(array("q", [0]), array("q", [n]), array("b", [0]))] if n else [(array("q"), array("q"), array("b"))]
        self._build()

    def _build(self) -> None:
        self.blocks = [b for b in self.blocks if b[0]] or self.blocks[:1]
        self.tree = [0] + [sum(b[1]) for b in self.blocks]
        for i in range(1, len(self.tree)):
            up = i + (i & -i)
            if up < len(self.tree):
                self.tree[up] += self.tree[i]

    def _add(self, block: int, by: int) -> None:
        i = block + 1
        while i < len(self.tree):
            self.tree[i] += by
            i += i & -i

    def _find(self, index: int):
        """Block, run and offset in the run of an index; behind the last run for the length."""
        at, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if at + step < len(self.tree) and self.tree[at + step] <= index:
                at += step
                index -= self.tree[at]
            step >>= 1
        if at == len(self.blocks):
            return at - 1, len(self.blocks[-1][0]), 0
        ends = list(accumulate(self.blocks[at][1]))
        k = bisect_right(ends, index)
        return at, k, index - (ends[k - 1] if k else 0)

    def _halve(self, block: int) -> None:
        if len(self.blocks[block][0]) > RUNS:
            half = RUNS // 2
            self.blocks[block:block + 1] = [tuple(a[:half] for a in self.blocks[block]), tuple(a[half:] for a in self.blocks[block])]
            self._build()

    def get(self, index: int) -> tuple[int, int]:
        b, k, off = self._find(index)
        first, _, mark = self.blocks[b]
        return first[k] + off, mark[k]

    def remove(self, index: int) -> tuple[int, int]:
        b, k, off = self._find(index)
        first, size, mark = self.blocks[b]
        got = first[k] + off, mark[k]
        rest = size[k] - off - 1
        if off:
            size[k] = off
            if rest:
                first.insert(k + 1, got[0] + 1)
                size.insert(k + 1, rest)
                mark.insert(k + 1, got[1])
        elif rest:
            first[k] += 1
            size[k] = rest
        else:
            for a in (first, size, mark):
                del a[k]
        self.n -= 1
        self._add(b, -1)
        self._halve(b)
        return got

    def insert(self, index: int, item: tuple[int, int]) -> None:
        b, k, off = self._find(index)
        first, size, mark = self.blocks[b]
        if off:
            first.insert(k + 1, first[k] + off)
            size.insert(k + 1, size[k] - off)
            mark.insert(k + 1, mark[k])
            size[k] = off
            k += 1
        if k and mark[k - 1] == item[1] and first[k - 1] + size[k - 1] == item[0]:
            size[k - 1] += 1
            if k < len(first) and mark[k] == item[1] and first[k] == item[0] + 1:
                size[k - 1] += size[k]
                for a in (first, size, mark):
                    del a[k]
        elif k < len(first) and mark[k] == item[1] and first[k] == item[0] + 1:
            first[k] -= 1
            size[k] += 1
        else:
            first.insert(k, item[0])
            size.insert(k, 1)
            mark.insert(k, item[1])
        self.n += 1
        self._add(b, 1)
        self._halve(b)

    def runs(self) -> Iterator[tuple[int, list[int], list[int], list[int]]]:
        """Block by block: index of the first item, then positions, lengths and marks of the runs."""
        at = 0
        for first, size, mark in self.blocks:
            if first:
                yield at, first.tolist(), size.tolist(), mark.tolist()
                at += sum(size)


class MovedRuns:
    """0..n-1 in a chained order of runs, for moves that name elements and not indexes."""

    def __init__(self, n: int):
        # Runs by their first element; ``heads`` sorted.  Element n is the end of the list.
        self.heads = [0, n] if n else [0]
        self.last = {0: n - 1, n: n}
        self.after, self.before = {0: n, n: 0}, {n: 0, 0: n}
        if not n:
            self.last, self.after, self.before = {0: 0}, {0: 0}, {0: 0}
        self.n = n

    def _cut(self, element: int) -> int:
        """Make the element the first of its run."""
        head = self.heads[bisect_right(self.heads, element) - 1]
        if head != element:
            insort(self.heads, element)
            self.last[element], self.last[head] = self.last[head], element - 1
            self._chain(element, self.after[head])
            self._chain(head, element)
        return element

    def _chain(self, a: int, b: int) -> None:
        self.after[a], self.before[b] = b, a

    def move(self, element: int, target: int | None) -> None:
        """Put the element in front of the target, None: at the end."""
        self._cut(element)
        if self.last[element] != element:
            self._cut(element + 1)
        self._chain(self.before[element], self.after[element])
        target = self._cut(self.n if target is None else target)
        self._chain(self.before[target], element)
        self._chain(element, target)

    def runs(self) -> Iterator[tuple[int, int]]:
        """First element and length of the runs in their order."""
        head = self.after[self.n]
        while head != self.n:
            yield head, self.last[head] - head + 1
            head = self.after[head]

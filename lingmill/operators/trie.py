"""A double-array trie over many strings, which finds all of them at every place of many texts at once.

A node is a place in two arrays: base, where its children begin, and check, whose child a place is.
The child for a character stands at base[node] + code, if check says so there. Nodes with several
children are placed by first fit, the most children first; those with one fill what is left.
All starts in a text walk down together, one character a step, and fall out where the trie ends.
What the strings on the way to a node are worth can be added up before: then a start needs only its last node.
"""

from __future__ import annotations

import numpy as np

#: Places that are tried at a time for a node; cells of the table of the first steps.
TRIED, FIRST_STEPS = 4096, 1 << 22


class Trie:
    """The distinct strings given; matches() names them by their place in `strings`."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = sorted({s for s in strings if s})
        points = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in self.strings]
        size = np.array([len(p) for p in points], np.int64)
        self.longest = int(size.max(initial=0))
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        known = np.unique(flat)
        #: Code of every character up to the highest one known; 0 is none of them.
        self.code = np.zeros(int(known[-1]) + 2 if len(known) else 2, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        #: Codes that there are, with that of no character.
        self.letters = len(known) + 1
        first = np.cumsum(size) - size
        codes = self.code[flat]
        # Level by level: a node for each distinct pair of a parent and a character.
        node = np.zeros(len(size), np.int64)
        parents, letters, count = [], [], 1
        ends = np.full(1, -1, np.int64)
        for depth in range(self.longest):
            here = np.flatnonzero(size > depth)
            pair, place = np.unique(node[here] << 32 | codes[first[here] + depth], return_inverse=True)
            parents.append(pair >> 32)
            letters.append(pair & 0xFFFFFFFF)
            node[here] = count + place
            ends = np.append(ends, np.full(len(pair), -1))
            done = here[size[here] == depth + 1]
            ends[node[done]] = done
            count += len(pair)
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        letter = np.concatenate(letters) if letters else np.zeros(0, np.int64)
        base = _placed(parent, letter, count, len(known) + 1)
        slot = np.zeros(count, np.int64)
        slot[1:] = base[parent] + letter
        width = int(base.max(initial=0)) + len(known) + 2
        self.base, self.check, self.ends = np.zeros(width, np.int32), np.full(width, -1, np.int32), np.full(width, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.ends[slot] = ends
        #: The nodes of every depth from 1 on.
        self.levels = np.split(slot[1:], np.cumsum([len(p) for p in parents])[:-1]) if parents else []
        self._heads: tuple[int, np.ndarray] | None = None

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The codes of characters."""
        return self.code[np.minimum(points, len(self.code) - 1)]

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start, string of everything found in codes; no string runs over a code of 0, so texts can stand behind one another with a 0 between."""
        at = np.flatnonzero(codes)
        node = np.zeros(len(at), np.int32)
        padded = np.append(codes, np.zeros(self.longest, codes.dtype))
        starts, found = [at[:0]], [node[:0]]
        for depth in range(self.longest):
            if not len(at):
                break
            to = self.base[node] + padded[at + depth]
            stays = self.check[to] == node
            at, node = at[stays], to[stays]
            string = self.ends[node]
            ended = np.flatnonzero(string >= 0)
            starts.append(at[ended])
            found.append(string[ended])
        return np.concatenate(starts), np.concatenate(found)

    def along(self, worth: np.ndarray) -> np.ndarray:
        """Of values by string (the last axis) the sums along the way to every node, by node."""
        out = np.zeros((*worth.shape[:-1], len(self.base)), worth.dtype)
        ends = np.flatnonzero(self.ends >= 0)
        out[..., ends] = worth[..., self.ends[ends]]
        for level in self.levels:
            out[..., level] += out[..., self.check[level]]
        return out

    def deepest(self, codes: np.ndarray) -> np.ndarray:
        """The last node that the walk from every place reaches, 0 for none; codes of 0 part texts as in matches().

        The first steps are looked up together in a table, as many as it has cells for.
        """
        if self._heads is None:
            self._heads = self._first_steps()
        steps, table = self._heads
        padded = np.append(codes, np.zeros(self.longest + steps, codes.dtype))
        cell = padded[: len(codes)]
        for k in range(1, steps):
            cell = cell * self.letters + padded[k : k + len(codes)]
        out = table[cell]
        at = np.flatnonzero(out > 0)
        node = out[at]
        np.abs(out, out=out)
        for depth in range(steps, self.longest):
            if not len(at):
                break
            to = self.base[node] + padded[at + depth]
            stays = self.check[to] == node
            at, node = at[stays], to[stays]
            out[at] = node
        return out

    def _first_steps(self) -> tuple[int, np.ndarray]:
        """How many steps a look-up takes (1 to 3), and by their codes the node reached; negative where the walk ended there or before."""
        steps = max([1, *(k for k in (2, 3) if k <= self.longest and self.letters**k <= FIRST_STEPS)])
        letters = np.arange(self.letters)
        node, alive = np.zeros(1, np.int64), np.ones(1, bool)
        for _ in range(steps):
            to = self.base[node][:, None] + letters
            on = alive[:, None] & (self.check[to] == node[:, None])
            node, alive = np.where(on, to, node[:, None]).ravel(), on.ravel()
        more = np.zeros(len(self.base), bool)
        more[self.check[self.check >= 0]] = True
        ended = ~(alive & more[node])
        return steps, np.where(ended, -node, node).astype(np.int32)


def _placed(parent: np.ndarray, letter: np.ndarray, count: int, width: int) -> np.ndarray:
    """base of every node: children stand at base + letter, no two at one place, none at 0."""
    base = np.zeros(count, np.int64)
    if not len(parent):
        return base
    order = np.argsort(parent, kind="stable")
    owner, first, many = np.unique(parent[order], return_index=True, return_counts=True)
    used = np.zeros(2 * len(parent) + 2 * width + 2 * TRIED, bool)
    used[0] = True
    low = 0
    for k in np.argsort(-many, kind="stable").tolist():
        if many[k] == 1:
            break
        own = letter[order[first[k] : first[k] + many[k]]]
        while True:
            if low + TRIED + width > len(used):
                used = np.append(used, np.zeros(len(used), bool))
            fits = ~used[low + np.arange(TRIED)[:, None] + own].any(axis=1)
            if fits.any():
                break
            low += TRIED
        base[owner[k]] = low + int(fits.argmax())
        used[base[owner[k]] + own] = True
    # A base may not be negative: an only child takes a free place from its letter on.
    alone = many == 1
    nodes, own = owner[alone], letter[order[first[alone]]]
    by = np.argsort(own, kind="stable")
    free = np.flatnonzero(~used)
    if len(free) < len(by) + width:
        free = np.append(free, len(used) + np.arange(len(by) + width))
    free = free[free >= width][: len(by)]
    base[nodes[by]] = free - own[by]
    return base

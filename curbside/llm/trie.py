"""A double-array trie over bytes, and all pieces found in many short strings at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class DoubleArrayTrie:
    """Child of state s by byte c: t = base[s] + c + 1, if check[t] == s. value[s] is the key's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = max(1024, 2 * sum(map(len, keys)) + 600)
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        taken = bytearray(size)
        taken[0] = 1
        free = 1
        queue = [(0, 0, len(order), 0)]  # state, its keys' range in `order`, depth
        for state, low, high, depth in queue:
            children: list[tuple[int, int, int]] = []
            for at in range(low, high):
                key = keys[order[at]]
                if len(key) == depth:
                    self.value[state] = order[at]
                elif children and children[-1][0] == key[depth]:
                    children[-1] = (key[depth], children[-1][1], at + 1)
                else:
                    children.append((key[depth], at, at + 1))
            if not children:
                continue
            while taken[free]:
                free += 1
            slot = free
            while True:  # the first place where all children find a free slot
                base = slot - children[0][0] - 1
                if base >= 0 and not any(taken[base + c + 1] for c, _, _ in children):
                    break
                slot = taken.find(0, slot + 1)
            self.base[state] = base
            for c, a, b in children:
                taken[base + c + 1] = 1
                self.check[base + c + 1] = state
                queue.append((base + c + 1, a, b, depth + 1))
        used = taken.rfind(1) + 258
        self.base, self.check, self.value = self.base[:used], self.check[:used], self.value[:used]


@dataclass
class Lattice:
    """Edges between byte positions of many strings laid end to end.

    A string of n bytes owns n + 1 positions. Edges are sorted by how far into its string they end, then by
    where; `steps` holds the bounds of each such distance. `key` is -1 for an edge over a character that no key covers.
    """

    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    steps: np.ndarray
    positions: int


def lattice(trie: DoubleArrayTrie, strings: list[bytes]) -> Lattice:
    """All keys found in each string. Characters (UTF-8) that are no key by themselves get an edge of key -1."""
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.cumsum(length + 1) - (length + 1)
    data = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8).astype(np.int64)
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    begin = begin[data[begin] != 0xFF]  # 0xff never occurs in UTF-8: it ends each string
    lead = data[begin]
    width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    covered = np.zeros(len(begin), bool)
    row, at, state = np.arange(len(begin)), begin, np.zeros(len(begin), np.int64)
    starts, ends, found = [], [], []
    while len(row):
        step = trie.base[state] + data[at] + 1
        good = trie.check[np.minimum(step, len(trie.check) - 1)] == state
        good &= (step < len(trie.check)) & (data[at] != 0xFF)
        row, at, state = row[good], at[good] + 1, step[good]
        value = trie.value[state]
        hit = np.flatnonzero(value >= 0)
        starts.append(begin[row[hit]])
        ends.append(at[hit])
        found.append(value[hit])
        single = hit[at[hit] - begin[row[hit]] == width[row[hit]]]
        covered[row[single]] = True
    bare = np.flatnonzero(~covered)
    starts.append(begin[bare])
    ends.append(begin[bare] + width[bare])
    found.append(np.full(len(bare), -1, np.int64))
    start, end, key = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
    owner = np.searchsorted(first, start, "right") - 1
    depth = end - first[owner]
    order = np.lexsort((start, end, depth))
    start, end, key, depth = start[order], end[order], key[order], depth[order]
    steps = np.flatnonzero(np.diff(depth, prepend=-1))
    return Lattice(first, first + length, start, end, key, np.append(steps, len(start)), len(data))


def best_paths(found: Lattice, scores: np.ndarray, bare: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys along the best path of each string, and how many each string has. scores: by key; bare: of key -1."""
    best = np.full(found.positions, -np.inf)
    best[found.first] = 0.0
    back = np.full(found.positions, -1, np.int64)
    gain = np.where(found.key >= 0, scores[found.key], bare)
    for a, b in zip(found.steps[:-1], found.steps[1:]):
        total = best[found.start[a:b]] + gain[a:b]
        group = np.flatnonzero(np.diff(found.end[a:b], prepend=-1))
        top = np.maximum.reduceat(total, group)
        many = np.diff(np.append(group, b - a))
        # the first of equal totals, which is the one that starts earliest
        edge = np.flatnonzero(total == np.repeat(top, many))
        target = found.end[a:b][edge]
        head = np.flatnonzero(np.diff(target, prepend=-1))
        best[target[head]] = total[edge[head]]
        back[target[head]] = a + edge[head]
    at, alive = found.last.copy(), np.arange(len(found.first))
    rows, keys, number = [], [], []
    turn = 0
    while True:
        more = at[alive] > found.first[alive]
        alive = alive[more]
        if not len(alive):
            break
        edge = back[at[alive]]
        rows.append(alive)
        keys.append(edge)
        number.append(np.full(len(alive), turn))
        at[alive] = found.start[edge]
        turn += 1
    if not rows:
        return np.zeros(0, np.int64), np.zeros(len(found.first), np.int64)
    row, edge, number = np.concatenate(rows), np.concatenate(keys), np.concatenate(number)
    order = np.lexsort((-number, row))
    return edge[order], np.bincount(row, minlength=len(found.first))


def path_sums(found: Lattice, scores: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Log of the sum over all paths to each position, for each column of `scores` (keys x columns)."""
    alpha = np.full((found.positions, scores.shape[1]), -np.inf)
    alpha[found.first] = 0.0
    for a, b in zip(found.steps[:-1], found.steps[1:]):
        key = found.key[a:b]
        total = alpha[found.start[a:b]] + np.where(key[:, None] >= 0, scores[key], bare)
        group = np.flatnonzero(np.diff(found.end[a:b], prepend=-1))
        top = np.maximum.reduceat(total, group, axis=0)
        many = np.diff(np.append(group, b - a))
        top = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            alpha[found.end[a:b][group]] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, many, 0)), group, axis=0))
    return alpha


def expected_counts(found: Lattice, scores: np.ndarray, bare: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each key is expected over all paths of each string, times the string's weight by column."""
    alpha = path_sums(found, scores, bare)
    beta = np.full_like(alpha, -np.inf)
    beta[found.last] = 0.0
    whole = alpha[found.last]
    owner = np.searchsorted(found.first, found.start, "right") - 1
    gain = np.where(found.key[:, None] >= 0, scores[found.key], bare)
    # the same steps from the other end: edges by how far before the end of their string they start
    order = np.lexsort((found.start, found.last[owner] - found.start))
    start, end = found.start[order], found.end[order]
    far = (found.last[owner] - found.start)[order]
    steps = np.append(np.flatnonzero(np.diff(far, prepend=-1)), len(start))
    for a, b in zip(steps[:-1], steps[1:]):
        total = beta[end[a:b]] + gain[order[a:b]]
        group = np.flatnonzero(np.diff(start[a:b], prepend=-1))
        top = np.maximum.reduceat(total, group, axis=0)
        top = np.where(np.isfinite(top), top, 0.0)
        many = np.diff(np.append(group, b - a))
        with np.errstate(divide="ignore"):
            beta[start[a:b][group]] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, many, 0)), group, axis=0))
    share = np.exp(alpha[found.start] + gain + beta[found.end] - whole[owner]) * weight[owner]
    out = np.zeros(scores.shape)
    keyed = found.key >= 0
    np.add.at(out, found.key[keyed], share[keyed])
    return out

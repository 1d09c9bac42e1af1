"""Re-Pair over short alphabets: a shared grammar of many symbol sequences, and min-plus matrices over its rules."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

#: A rope is a string or a pair of ropes; a matrix entry is (cost, rope) or None for "impossible".
Rope = str | tuple
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def repair(sequences: list[list[int]], first_rule: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Replace the most frequent pair of neighbours by a new symbol until no pair occurs twice.

    Returns the compressed sequences and the rules; rule k is the symbol ``first_rule + k``.  Pairs never cross
    sequences.  Of equally frequent pairs the least is taken, so equal input gives equal grammars.  Neighbours are a
    linked list and only the pairs around a replaced place are counted again.
    """
    symbol: list[int] = []
    for s in sequences:
        symbol += s
        symbol.append(-1)  # a barrier, never part of a pair
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}

    def add(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and symbol[i] >= 0 and symbol[j] >= 0:
            places.setdefault((symbol[i], symbol[j]), set()).add(i)

    def remove(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and (found := places.get((symbol[i], symbol[j]))) is not None:
            found.discard(i)

    for i in range(n):
        add(i)
    queue = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(queue)
    rules: list[tuple[int, int]] = []
    while queue:
        count, pair = heapq.heappop(queue)
        now = len(places.get(pair, ()))
        if now != -count:
            if now > 1:
                heapq.heappush(queue, (-now, pair))
            continue
        fresh, replaced, touched = first_rule + len(rules), 0, set()
        for i in sorted(places[pair]):
            j = after[i]
            if j >= n or symbol[i] != pair[0] or symbol[j] != pair[1]:
                continue  # the place before, in a run of equal symbols, took this one
            p, q = before[i], after[j]
            remove(p)
            remove(i)
            remove(j)
            symbol[i], symbol[j] = fresh, -1
            after[i], before[q] = q, i  # a barrier ends every sequence, so q exists
            after[j] = before[j] = n
            add(p)
            add(i)
            if p >= 0 and symbol[p] >= 0:
                touched.add((symbol[p], fresh))
            if symbol[q] >= 0:
                touched.add((fresh, symbol[q]))
            replaced += 1
        places.pop(pair, None)
        if replaced:
            rules.append(pair)
        for found in touched:
            if len(places.get(found, ())) > 1:
                heapq.heappush(queue, (-len(places[found]), found))
    out, i, at = [], 0, 0
    for s in sequences:
        end, row = at + len(s), []
        i = at
        while i < end:
            row.append(symbol[i])
            i = after[i]
        out.append(row)
        at = end + 1
    return out, rules


def letters(rope: Rope) -> Iterator[str]:
    """The strings that a rope is made of."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if top:
                yield top
        else:
            stack.append(top[1])
            stack.append(top[0])


def flat(rope: Rope) -> str:
    return "".join(letters(rope))


def less(a: Rope, b: Rope) -> bool:
    """Whether rope a sorts before rope b.  Common parts at the same place are skipped, the rest is read up to the first difference."""
    left, right, x, y = [a], [b], "", ""
    while True:
        if not x and not y and left and right and left[-1] is right[-1]:
            left.pop()
            right.pop()
            continue
        while not x and left:
            top = left.pop()
            if isinstance(top, str):
                x = top
            else:
                left += (top[1], top[0])
                if not y and right and left[-1] is right[-1]:
                    break
        if not x and left:
            continue
        while not y and right:
            top = right.pop()
            if isinstance(top, str):
                y = top
            else:
                right += (top[1], top[0])
        if not x or not y:
            return not x and bool(y)
        k = min(len(x), len(y))
        if x[:k] != y[:k]:
            return x[:k] < y[:k]
        x, y = x[k:], y[k:]


def better(a: Entry, b: Entry) -> Entry:
    """The cheaper entry; of equal costs the least rope."""
    if a is None or (b is not None and (b[0] < a[0] or (b[0] == a[0] and less(b[1], a[1])))):
        return b
    return a


def then(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return None
    if not a[1]:
        return a[0] + b[0], b[1]
    return a[0] + b[0], (a[1], b[1]) if b[1] else a[1]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; a row alone (a list of one row) works as well."""
    out: Matrix = []
    for row in a:
        made: list[Entry] = []
        for q in range(len(b[0])):
            best: Entry = None
            for k, x in enumerate(row):
                if x is not None and b[k][q] is not None and (best is None or x[0] + b[k][q][0] <= best[0]):
                    best = better(best, then(x, b[k][q]))
            made.append(best)
        out.append(made)
    return out


def rule_matrices(rules: list[tuple[int, int]], base: dict[int, Matrix], first_rule: int) -> dict[int, Matrix]:
    """One matrix for each symbol and rule, bottom-up: each rule is one product, however often it is used."""
    out = dict(base)
    for k, (a, b) in enumerate(rules):
        out[first_rule + k] = product(out[a], out[b])
    return out

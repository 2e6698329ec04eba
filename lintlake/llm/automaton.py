"""Regular expressions over bytes to minimal deterministic automata (subset construction, partition refinement).

Syntax: literals, escapes (``\\xhh`` or a quoted sign), classes, groups, ``|``, ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    """Pattern to a tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.text, self.at, self.any_case = pattern, 0, any_case

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("rep", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("rep", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def cased(self, values: set[int]):
        if self.any_case:
            values |= {v ^ 32 for v in values if chr(v).isalpha() and v < 128}
        return ("set", frozenset(values))

    def sign(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.alternatives()
            self.take()
            return inner
        if self.peek() != "[":
            return self.cased({self.sign()})
        self.take()
        values: set[int] = set()
        while self.peek() != "]":
            low = self.sign()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                values |= set(range(low, self.sign() + 1))
            else:
                values.add(low)
        self.take()
        return self.cased(values)


def _mirrored(tree):
    """The tree of the same pattern read backwards."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _mirrored(tree[1]), *tree[2:])
    parts = [_mirrored(p) for p in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The state in which ``tree`` ends, begun in ``start``."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.moves[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[start].append(end)
            for _ in range(high - low):
                start = self.add(part, start)
                self.free[start].append(end)
        return end


class Automaton:
    """A minimal automaton for several patterns: ``table`` (states, 256), ``accepts`` (bit per pattern); state 0 starts.

    If ``anywhere``, matches may begin at any byte; else only at the first, and ``dead`` is the state of no return.
    ``backwards`` reads patterns and texts from the end, so that a match is seen where it begins.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> None:
        nfa = _Nfa()
        start, ends = nfa.state(), {}
        for bit, (pattern, any_case) in enumerate(patterns):
            own = nfa.state()
            nfa.free[start].append(own)
            tree = _Parser(pattern, any_case).alternatives()
            ends[nfa.add(_mirrored(tree) if backwards else tree, own)] = 1 << bit
        sets = {m[0] for m in nfa.moves if m}
        kinds = np.zeros(256, np.int64)
        for s in sets:  # bytes that no pattern tells apart form one kind
            mark = np.zeros(256, np.int64)
            mark[list(s)] = 1
            kinds = np.unique(kinds * 2 + mark, return_inverse=True)[1]
        n_kinds = int(kinds.max()) + 1
        sample = [int(np.flatnonzero(kinds == k)[0]) for k in range(n_kinds)]

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for y in nfa.free[todo.pop()]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return frozenset(x for x in seen if nfa.moves[x] or x in ends)

        first = closed({start})
        number, todo, rows = {first: 0}, [first], []
        while len(rows) < len(todo):
            here = todo[len(rows)]
            row = []
            for k in sample:
                to = {nfa.moves[x][1] for x in here if nfa.moves[x] and k in nfa.moves[x][0]}
                then = closed(to | {start}) if anywhere else closed(to)
                if then not in number:
                    number[then] = len(todo)
                    todo.append(then)
                row.append(number[then])
            rows.append(row)
        moves = np.array(rows, np.int64)
        accepts = np.array([sum({ends[x] for x in s if x in ends}) for s in todo], np.int64)
        part = np.unique(accepts, return_inverse=True)[1]
        while True:  # refine until states of a class agree on the classes they lead to
            new = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
            if new.max() == part.max():
                break
            part = new
        order = np.unique(part, return_index=True)[1]
        by_mask = sorted(range(len(order)), key=lambda c: (c != part[0], accepts[order[c]] != 0))
        place = np.empty(len(order), np.int64)
        place[by_mask] = np.arange(len(order))
        rep = order[by_mask]
        self.table = place[part[moves[rep]]][:, kinds]
        self.accepts = accepts[rep]
        loops = (self.table == np.arange(len(rep))[:, None]).all(axis=1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(loops)[0]) if loops.any() else -1
        self.flat = (self.table * 256).reshape(-1).tolist()
        #: masks by state; states from ``final`` on accept (state 0 never does)
        self.masks = {256 * i: int(m) for i, m in enumerate(self.accepts) if m}
        self.final = min(self.masks, default=1 << 62)

    def scan(self, data: bytes) -> int:
        """The patterns that match somewhere (or, if not ``anywhere``, a beginning), as bits; one pass."""
        flat, final, masks, state, hit = self.flat, self.final, self.masks, 0, 0
        for b in data:
            state = flat[state + b]
            if state >= final:
                hit |= masks[state]
        return hit

    def begins(self, data: bytes) -> list[tuple[int, int]]:
        """(place, patterns as bits) of every place where a match begins, first to last; one pass from the end. For an
        automaton that reads backwards."""
        flat, final, masks, state, at, out = self.flat, self.final, self.masks, 0, len(data), []
        for b in reversed(data):
            at -= 1
            state = flat[state + b]
            if state >= final:
                out.append((at, masks[state]))
        out.reverse()
        return out

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        flat, final, dead, state, end = self.flat, self.final, self.dead * 256, 0, -1
        for i in range(start, len(data)):
            state = flat[state + data[i]]
            if state >= final:
                end = i + 1
            elif state == dead:
                break
        return end

"""Regular expressions as one deterministic automaton over bytes: subset construction, minimisation, transition arrays."""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

import numpy as np

_ALL = (1 << 256) - 1


class _Nfa:
    """States with free moves and moves on sets of bytes, given as bits."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, parsed, at: int, fold: bool, backwards: bool) -> int:
        """The parsed expression from state ``at`` on; its last state."""
        for op, arg in reversed(list(parsed)) if backwards else parsed:
            if op is K.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & re.IGNORECASE), backwards)
            elif op is K.BRANCH:
                end = self.state()
                for part in arg[1]:
                    self.free[self.add(part, self._fresh(at), fold, backwards)].append(end)
                at = end
            elif op is K.MAX_REPEAT:
                least, most, part = arg
                for _ in range(least):
                    at = self.add(part, at, fold, backwards)
                if most is K.MAXREPEAT:
                    loop = self._fresh(at)
                    self.free[self.add(part, loop, fold, backwards)].append(loop)
                    at = self._fresh(loop)
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self.add(part, at, fold, backwards)
                    self.free[at].append(end)
                    at = end
            else:
                end = self.state()
                self.moves[at].append((self._bytes(op, arg, fold), end))
                at = end
        return at

    def _fresh(self, at: int) -> int:
        new = self.state()
        self.free[at].append(new)
        return new

    def _bytes(self, op, arg, fold: bool) -> int:
        if op is K.LITERAL:
            found = 1 << arg
        elif op is K.NOT_LITERAL:
            return _ALL & ~self._bytes(K.LITERAL, arg, fold)
        elif op is K.RANGE:
            found = sum(1 << b for b in range(arg[0], arg[1] + 1))
        elif op is K.IN:
            inverted = arg[0][0] is K.NEGATE
            found = 0
            for o, a in arg[inverted:]:
                found |= self._bytes(o, a, fold)
            return _ALL & ~found if inverted else found
        else:
            raise ValueError(f"{op} isn't known here")
        if fold:
            for b in range(65, 91):
                if found >> b & 1 or found >> (b + 32) & 1:
                    found |= 1 << b | 1 << (b + 32)
        return found

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _shortest(parsed) -> list:
    """The parsed expression without what may lengthen its end."""
    *front, (op, arg) = list(parsed)
    if op is K.MAX_REPEAT and arg[0]:
        arg = (arg[0], arg[0], arg[2])
    elif op is K.SUBPATTERN:
        arg = (*arg[:3], _shortest(arg[3]))
    return [*front, (op, arg)]


class Dfa:
    """The minimal automaton of some expressions.

    ``classes`` maps bytes to classes that no expression tells apart. States are offsets into ``table``, so that
    ``table[state + class]`` is the next one. States from ``accepting`` on end a match, of the expressions in ``ends``.
    ``dead`` is the state that nothing leaves, or -1. With ``anywhere`` a match may begin at any byte, and only its first
    end counts, which keeps the repeats at the expressions' ends out of each other's way.
    """

    def __init__(self, patterns: list[str], anywhere: bool = False, backwards: bool = False):
        nfa = _Nfa()
        start = nfa.state()
        parsed = [_shortest(_parser.parse(p)) if anywhere else _parser.parse(p) for p in patterns]
        finals = {nfa.add(p, nfa._fresh(start), False, backwards): i for i, p in enumerate(parsed)}
        sets = sorted({m for moves in nfa.moves for m, _ in moves})
        signs = [tuple(m >> b & 1 for m in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signs))}
        self.classes = bytes(kinds[s] for s in signs)
        firsts = [signs.index(s) for s in kinds]
        begin = nfa.closed([start])
        numbers, rows = {begin: 0}, []
        todo = [begin]
        for subset in todo:  # grows: subset construction
            row = []
            for b in firsts:
                to = {t for q in subset for m, t in nfa.moves[q] if m >> b & 1}
                to = nfa.closed(to) | begin if anywhere else nfa.closed(to)
                if to not in numbers:
                    numbers[to] = len(todo)
                    todo.append(to)
                row.append(numbers[to])
            rows.append(row)
        ends = [tuple(sorted(finals[q] for q in subset if q in finals)) for subset in todo]
        self._minimise(np.array(rows), ends)

    def _minimise(self, rows: np.ndarray, ends: list[tuple[int, ...]]) -> None:
        marks = {e: i for i, e in enumerate(dict.fromkeys(ends))}
        part = np.array([marks[e] for e in ends])
        while True:  # split parts whose members go to different parts, until none does
            _, finer = np.unique(np.column_stack((part, part[rows])), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == part.max():
                break
            part = finer
        member = np.unique(part, return_index=True)[1]
        accepts = np.array([bool(ends[m]) for m in member])
        order = np.argsort(accepts, kind="stable")  # those that end a match come last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = rows.shape[1]
        self.width = width
        self.table = (place[part[rows[member[order]]]] * width).ravel().tolist()
        self.accepting = int((~accepts).sum()) * width
        self.ends = {int(i) * width: ends[member[o]] for i, o in enumerate(order) if ends[member[o]]}
        self.start = int(place[part[0]]) * width
        still = [s for s in range(0, self.accepting, width) if set(self.table[s:s + width]) == {s}]
        self.dead = still[0] if still else -1

    @property
    def states(self) -> int:
        return len(self.table) // self.width

    def last(self, data: bytes, indexes) -> int:
        """The last of the byte positions that ends a match, going along ``indexes`` from the start state, or -1."""
        state, table, classes, found = self.start, self.table, self.classes, -1
        for i in indexes:
            state = table[state + classes[data[i]]]
            if state >= self.accepting:
                found = i
            elif state == self.dead:
                break
        return found

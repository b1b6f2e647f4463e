"""Finite automata over edge labels: start state 1, one final state."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

START = 1
Label = int | str


@dataclass(frozen=True)
class Automaton:
    """Transitions ``(q, label, t)``; ``final`` defaults to the number of states.

    The empty word never matches: an answer needs at least one edge even if state 1 is final.
    """

    transitions: tuple[tuple[int, Label, int], ...]
    n_states: int
    final: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "transitions", tuple(dict.fromkeys(self.transitions)))
        if self.final is None:
            object.__setattr__(self, "final", self.n_states)
        states = {s for q, _, t in self.transitions for s in (q, t)} | {self.final}
        if states and not all(1 <= s <= self.n_states for s in states):
            raise ValueError(f"states must lie in 1..{self.n_states}: {sorted(states)}")

    @classmethod
    def of(cls, text: str, final: int | None = None) -> "Automaton":
        """From ``"1 5 2; 2 6 2; 2 7 3"`` (``q label t``)."""
        rows = [r.split() for r in text.split(";") if r.strip()]
        steps = tuple((int(q), int(lab) if lab.lstrip("-").isdigit() else lab, int(t)) for q, lab, t in rows)
        return cls(steps, max(max(q, t) for q, _, t in steps), final)

    @cached_property
    def labels(self) -> list[Label]:
        return sorted({lab for _, lab, _ in self.transitions})

    def leaving(self, states) -> list[tuple[int, Label, int]]:
        return [s for s in self.transitions if s[0] in states]

    @cached_property
    def inner(self) -> "Automaton":
        """Without the transitions of a start state that nothing enters: all that is followed after the first edge."""
        entered = {t for _, _, t in self.transitions}
        return Automaton(tuple(s for s in self.transitions if s[0] in entered), self.n_states, self.final)

    @cached_property
    def beginning(self) -> "Automaton":
        """Only the transitions of the start state."""
        return Automaton(tuple(self.leaving({START})), self.n_states, self.final)

    @cached_property
    def ending(self) -> "Automaton":
        """Only the transitions into the final state."""
        return Automaton(tuple(s for s in self.transitions if s[2] == self.final), self.n_states, self.final)

    @cached_property
    def reversed(self) -> "Automaton":
        """Every transition the other way round, from the final state to the start."""
        return Automaton(tuple((t, lab, q) for q, lab, t in self.transitions), self.n_states, START)

    def reaches(self, states) -> frozenset[int]:
        """States that one transition or more leads to."""
        forward = defaultdict(set)
        for q, _, t in self.transitions:
            forward[q].add(t)
        return frozenset(_closure(set(self.successors(states)), forward))

    def labels_from(self, states) -> list[Label]:
        return sorted({lab for _, lab, _ in self.leaving(states)})

    def successors(self, states) -> frozenset[int]:
        return frozenset(t for _, _, t in self.leaving(states))

    @cached_property
    def trimmed(self) -> "Automaton":
        """Only transitions on some way from the start to the final state; answers do not change."""
        forward, backward = defaultdict(set), defaultdict(set)
        for q, _, t in self.transitions:
            forward[q].add(t)
            backward[t].add(q)
        useful = _closure({START}, forward) & _closure({self.final}, backward)
        kept = tuple(s for s in self.transitions if s[0] in useful and s[2] in useful)
        return Automaton(kept, self.n_states, self.final)

    @cached_property
    def branches(self) -> dict[int, int]:
        """Inner state -> branch number, where branches share only the start and the final state.

        Raises unless counting distinct last states decides the conjunction: no transition enters the start or leaves
        the final state, and every branch reaches the final state from exactly one state of its own.
        """
        ends = {START, self.final}
        if START == self.final or any(t == START or q == self.final for q, _, t in self.transitions):
            raise ValueError("a transition enters the start state or leaves the final state")
        if any(q == START and t == self.final for q, _, t in self.transitions):
            raise ValueError("a branch needs a state of its own before the final state")
        near = defaultdict(set)
        for q, _, t in self.transitions:
            if q not in ends and t not in ends:
                near[q].add(t)
                near[t].add(q)
        inner = sorted({s for q, _, t in self.transitions for s in (q, t)} - ends)
        branch: dict[int, int] = {}
        for s in inner:
            if s not in branch:
                number = len(set(branch.values()))
                branch.update(dict.fromkeys(_closure({s}, near), number))
        started = {branch[t] for q, _, t in self.transitions if q == START}
        for number in set(branch.values()):
            last = {q for q, _, t in self.transitions if t == self.final and branch[q] == number}
            if len(last) != 1 or number not in started:
                raise ValueError(f"branch {number} must start at state 1 and end from one state; it ends from {sorted(last)}")
        return branch

    @cached_property
    def last_states(self) -> list[int]:
        return sorted({q for q, _, t in self.transitions if t == self.final})

    def start_label_groups(self) -> list[list[Label]]:
        """One list per branch: a source needs an edge with at least one label of every list."""
        groups = defaultdict(set)
        for q, lab, t in self.transitions:
            if q == START:
                groups[self.branches[t]].add(lab)
        return [sorted(groups[b]) for b in sorted(groups)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        kind = "string" if any(isinstance(lab, str) for lab in self.labels) else "int"
        rows = [(q, str(lab) if kind == "string" else lab, t) for q, lab, t in self.transitions]
        return spark.createDataFrame(rows, f"q int, label {kind}, t int")


def _closure(seed: set[int], step: dict[int, set[int]]) -> set[int]:
    seen, todo = set(seed), list(seed)
    while todo:
        for t in step.get(todo.pop(), ()):
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen

"""Weighted finite-state transducers over the words of a clause, and their composition.

A transducer reads one symbol per word and writes one, with a factor; it may take several arcs on the same
symbol, and a path counts if it ends in a final state. In a composition the second machine reads what
the first one writes, and factors multiply. A clause scores the sum over its words of factor times the word's
own weight, on the best path. The machines below are unambiguous: each clause has one path that counts, so
what a later word decides (a negation or a target that follows) is guessed earlier and proved later.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

SYMBOLS = ("other", "insult", "threat", "intent", "target", "negation", "report")
Arc = tuple[Hashable, str, float]

# What a match costs, by what governs it (fixed choices of this grammar).
NEGATED = 1 / 3
REPORTED = 1 / 2
AIMED = 1.5
UNAIMED_THREAT = 0.25
SAME_BREATH = 0.5
NEGATION_REACH = 3
NEGATION_AFTER = 2


class Transducer(NamedTuple):
    start: Hashable
    finals: frozenset
    arcs: Mapping[Hashable, Mapping[str, Sequence[Arc]]]

    def best(self, symbols: Sequence[str], weights: Sequence[float]) -> float | None:
        """The greatest sum of factor times weight over all paths that count; None if there is none."""
        scores: dict[Hashable, float] = {self.start: 0.0}
        for symbol, weight in zip(symbols, weights):
            after: dict[Hashable, float] = {}
            for state, score in scores.items():
                for to, _, factor in self.arcs.get(state, {}).get(symbol, ()):
                    reached = score + factor * weight
                    if reached > after.get(to, float("-inf")):
                        after[to] = reached
            scores = after
        ends = [score for state, score in scores.items() if state in self.finals]
        return max(ends) if ends else None


def transducer(start: Hashable, finals: Iterable[Hashable], arcs: Iterable[tuple[Hashable, str, Hashable, str, float]]) -> Transducer:
    """From rows (state, symbol read, next state, symbol written, factor)."""
    table: dict[Hashable, dict[str, list[Arc]]] = {}
    for state, reads, to, writes, factor in arcs:
        table.setdefault(state, {}).setdefault(reads, []).append((to, writes, factor))
    return Transducer(start, frozenset(finals), table)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that does what `second` does with what `first` writes: states that can be reached, and that reach an end."""
    start = (first.start, second.start)
    arcs, waiting, seen = [], [start], {start}
    while waiting:
        state = waiting.pop()
        for reads, own in first.arcs.get(state[0], {}).items():
            for to1, between, factor1 in own:
                for to2, writes, factor2 in second.arcs.get(state[1], {}).get(between, ()):
                    to = (to1, to2)
                    arcs.append((state, reads, to, writes, factor1 * factor2))
                    if to not in seen:
                        seen.add(to)
                        waiting.append(to)
    finals = {state for state in seen if state[0] in first.finals and state[1] in second.finals}
    alive, grown = set(finals), True
    while grown:
        more = {state for state, _, to, _, _ in arcs if to in alive} - alive
        grown = bool(more)
        alive |= more
    names = {state: i for i, state in enumerate(sorted(alive | {start}, key=repr))}
    kept = [(names[s], reads, names[to], writes, f) for s, reads, to, writes, f in arcs if s in alive and to in alive]
    return transducer(names[start], {names[s] for s in finals}, kept)


def insults() -> Transducer:
    """An insult directly after another one belongs to the same breath and counts half."""
    arcs = []
    for state in ("fresh", "breath"):
        for symbol in SYMBOLS:
            factor = SAME_BREATH if symbol == "insult" and state == "breath" else 1.0
            arcs.append((state, symbol, "breath" if symbol == "insult" else "fresh", symbol, factor))
    return transducer("fresh", ("fresh", "breath"), arcs)


def threats() -> Transducer:
    """A verb threatens once the clause has told an intent; before it is like any other word."""
    arcs = []
    for state in ("none", "intent"):
        for symbol in SYMBOLS:
            idle = symbol == "threat" and state == "none"
            writes = "other" if symbol == "intent" or idle else symbol
            arcs.append((state, symbol, "intent" if symbol == "intent" else state, writes, 0.0 if idle else 1.0))
    return transducer("none", ("none", "intent"), arcs)


def negations() -> Transducer:
    """A negation weakens matches up to `NEGATION_REACH` words after it and `NEGATION_AFTER` words before it.

    State (scope, must, never): words left in a negation's scope; words within which a negation must come, as a
    match has been taken for negated; words within which none may come, as one has been taken for plain. 0 is none.
    """
    start = (0, 0, 0)
    arcs, waiting, seen = [], [start], {start}
    while waiting:
        scope, must, never = state = waiting.pop()
        left = max(scope - 1, 0)
        steps = []
        for symbol in SYMBOLS:
            if symbol == "negation":
                if not never:
                    steps.append((symbol, (NEGATION_REACH, 0, 0), 1.0))
                continue
            if must == 1:  # the word within which the negation had to come
                continue
            now = (left, max(must - 1, 0), max(never - 1, 0))
            if symbol not in ("insult", "threat"):
                steps.append((symbol, now, 1.0))
            elif scope:
                steps.append((symbol, now, NEGATED))
            else:
                # Negated later on, or not: either has to be borne out by the words that follow.
                soon = NEGATION_AFTER if not must else min(must - 1, NEGATION_AFTER)
                if soon > max(never - 1, 0):
                    steps.append((symbol, (left, soon, max(never - 1, 0)), NEGATED))
                if not must:
                    steps.append((symbol, (left, 0, NEGATION_AFTER), 1.0))
                elif must - 1 > NEGATION_AFTER:
                    steps.append((symbol, (left, must - 1, NEGATION_AFTER), 1.0))
        for symbol, to, factor in steps:
            arcs.append((state, symbol, to, symbol, factor))
            if to not in seen:
                seen.add(to)
                waiting.append(to)
    return transducer(start, [state for state in seen if not state[1]], arcs)


def _somewhere(wanted: str, factors: Mapping[str, float], otherwise: Mapping[str, float]) -> Transducer:
    """Clauses with the `wanted` symbol anywhere take `factors`, those without take `otherwise`."""
    arcs = []
    for symbol in SYMBOLS:
        here = symbol == wanted
        for state in ("start", "awaited"):
            arcs.append((state, symbol, "found" if here else "awaited", symbol, factors.get(symbol, 1.0)))
        arcs.append(("found", symbol, "found", symbol, factors.get(symbol, 1.0)))
        if not here:
            for state in ("start", "absent"):
                arcs.append((state, symbol, "absent", symbol, otherwise.get(symbol, 1.0)))
    return transducer("start", ("start", "found", "absent"), arcs)


def targets() -> Transducer:
    """A clause aimed at someone weighs more; a threat at nobody hardly counts."""
    return _somewhere("target", {"insult": AIMED, "threat": AIMED}, {"threat": UNAIMED_THREAT})


def reports() -> Transducer:
    """What a clause only reports counts half."""
    return _somewhere("report", {"insult": REPORTED, "threat": REPORTED}, {})


def grammar() -> Transducer:
    return reduce(compose, (insults(), threats(), targets(), negations(), reports()))

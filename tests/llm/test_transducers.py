"""Composed transducers against all paths of the machines one after the other."""

import random

from placetime.llm import transducers as t


def paths(machine, symbols):
    """(symbols written, factors) of every path that counts."""
    found = [(machine.start, (), ())]
    for symbol in symbols:
        found = [
            (to, (*out, writes), (*factors, factor))
            for state, out, factors in found
            for to, writes, factor in machine.arcs.get(state, {}).get(symbol, ())
        ]
    return [(out, factors) for state, out, factors in found if state in machine.finals]


def cascade(machines, symbols):
    """Factors of every path through all machines, each reading what the one before wrote."""
    found = [(tuple(symbols), (1.0,) * len(symbols))]
    for machine in machines:
        found = [(out, tuple(a * b for a, b in zip(factors, more))) for given, factors in found for out, more in paths(machine, given)]
    return [factors for _, factors in found]


MACHINES = (t.insults, t.threats, t.targets, t.negations, t.reports)


def test_the_composition_is_the_cascade():
    rng = random.Random(6)
    composed, machines = t.grammar(), [make() for make in MACHINES]
    for _ in range(1500):
        symbols = rng.choices(t.SYMBOLS, weights=(2, 3, 2, 1, 1, 2, 1), k=rng.randint(0, 8))
        weights = [rng.choice([0.0, 1.0, 2.5]) for _ in symbols]
        factors = cascade(machines, symbols)
        assert len(factors) == 1  # unambiguous
        want = sum(f * w for f, w in zip(factors[0], weights))
        assert abs(composed.best(symbols, weights) - want) < 1e-9


def test_negations_reach_words_on_both_sides():
    machine, rng = t.negations(), random.Random(7)
    for _ in range(1500):
        symbols = rng.choices(("other", "insult", "threat", "negation"), k=rng.randint(1, 10))
        ((_, factors),) = paths(machine, symbols)
        for i, symbol in enumerate(symbols):
            near = "negation" in symbols[max(0, i - t.NEGATION_REACH) : i] or "negation" in symbols[i + 1 : i + 1 + t.NEGATION_AFTER]
            assert factors[i] == (t.NEGATED if near and symbol in ("insult", "threat") else 1.0), symbols


def test_what_the_machines_say():
    best = t.grammar().best
    assert best(["target", "other", "insult"], [0, 0, 3]) == 3 * t.AIMED
    assert best(["insult", "other", "target"], [3, 0, 0]) == 3 * t.AIMED
    assert best(["insult", "insult"], [3, 2]) == 3 + 2 * t.SAME_BREATH
    assert best(["intent", "threat", "target"], [0, 2, 0]) == 2 * t.AIMED
    assert best(["intent", "threat"], [0, 2]) == 2 * t.UNAIMED_THREAT
    assert best(["threat", "intent"], [2, 0]) == 0.0
    assert best(["insult", "other", "report"], [4, 0, 0]) == 4 * t.REPORTED
    assert best([], []) == 0.0
    assert t.Transducer("a", frozenset(), {}).best(["other"], [1]) is None

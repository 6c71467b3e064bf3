"""Rules one change away from a rule that found nothing, in a fixed order of trial."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import DataFrame

from tessera.logic.parser import Condition, Rule, parse_rule

#: Fixed pairs: what each operator is swapped for.
SWAPS = {">": ">=", "<": "<=", ">=": ">", "<=": "<", "=": "!=", "!=": "="}


@dataclass(frozen=True)
class Candidate:
    source: str
    change: str
    kind: str  # operator, threshold, relax


def _text(rule: Rule, conditions: list[Condition]) -> str:
    return f"{rule.head} :- {', '.join([*map(str, rule.atoms), *map(str, conditions)])}."


def _scaled(value: str, factor: Decimal) -> str:
    out = (Decimal(value) * factor).normalize()
    return f"{out:f}"


def candidates(source: str) -> Iterator[Candidate]:
    """Operator swaps and thresholds ÷10 and ×10 of each condition in turn, then each condition left out, if several.

    Only rules with a head are repaired; a rule of atoms alone has no candidates.
    """
    rule = parse_rule(source)
    if rule.head is None:
        return
    own = list(rule.conditions)
    for i, c in enumerate(own):
        put = lambda new, i=i: _text(rule, [*own[:i], new, *own[i + 1 :]])
        yield Candidate(put(replace(c, op=SWAPS[c.op])), f"'{c}': {c.op} to {SWAPS[c.op]}", "operator")
        if c.is_number and Decimal(c.right) != 0:
            for factor, word in ((Decimal("0.1"), "÷10"), (Decimal(10), "×10")):
                yield Candidate(put(replace(c, right=_scaled(c.right, factor))), f"'{c}': threshold {word}", "threshold")
    if len(own) > 1:
        for i, c in enumerate(own):
            yield Candidate(_text(rule, own[:i] + own[i + 1 :]), f"without '{c}'", "relax")


def attempt(source: str, evaluate: Callable[[str], DataFrame]) -> tuple[Candidate, DataFrame] | None:
    """The first candidate that finds a row, with its rows; each probe reads until one row is found."""
    for candidate in candidates(source):
        found = evaluate(candidate.source)
        if not found.limit(1).isEmpty():
            return candidate, found
    return None

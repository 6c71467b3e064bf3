"""One text for rules that differ only in spelling."""

from __future__ import annotations

from tessera.logic.parser import Condition, Rule, parse_rule


def _side(condition: Condition) -> str:
    left = condition.left
    name = f"{left.variable.upper()}.{left.column.lower()}" if left.variable else left.column
    ref = condition.right_ref
    right = f"{ref.variable.upper()}.{ref.column.lower()}" if ref else condition.right
    return f"{name} {condition.op} {right}"


def canonical(source: str, upper_bare: bool = False) -> str:
    """Lower-case relations, upper-case variables, sorted atoms, conditions sorted by column, single spaces, final stop.

    A bare constraint keeps the case of its columns, since results look columns up by name; upper_bare gives the
    historical spelling, all in capitals.
    """
    if not (source or "").strip():
        return ""
    rule: Rule = parse_rule(source)
    if rule.head is None:
        texts = [f"{c.left.column.upper() if upper_bare else c.left.column} {c.op} {c.right}" for c in rule.conditions]
        return " AND ".join(sorted(texts, key=str.upper))
    variable = lambda a: a if a[:1] in "'\"" or a[:1].isdigit() else a.upper()
    atom = lambda a: f"{a.relation.lower()}({', '.join(variable(x) for x in a.args)})"
    conditions = sorted((_side(c) for c in rule.conditions), key=lambda t: (t.split(" ", 1)[0], t))
    return f"{atom(rule.head)} :- {', '.join([*sorted(atom(a) for a in rule.atoms), *conditions])}."

"""Schema-aware checks of rules: vocabulary, scope, types, syntax."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.errors import RuleError
from tessera.logic.parser import Condition, Rule, parse_rule


@dataclass(frozen=True)
class Finding:
    category: str  # VOCABULARY, SCOPE, TYPE, SYNTAX
    message: str
    fragment: str = ""
    suggestion: str | None = None

    def __str__(self) -> str:
        return f"[{self.category}] {self.message}" + (f" (suggestion: {self.suggestion})" if self.suggestion else "")


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def nearest(name: str, known: list[str], most: int = 2) -> str | None:
    """The known name of the least edit distance, at most that; ties go to the first by name."""
    within = [(levenshtein(name, k), k) for k in known]
    return min((x for x in within if x[0] <= most), default=(0, None))[1]


class Checker:
    """Checks rules against a catalog of relation schemas (name to StructType)."""

    def __init__(self, schemas: dict[str, T.StructType]):
        self.schemas = {k.lower(): v for k, v in schemas.items()}

    def check(self, source: str) -> list[Finding]:
        """All findings; none if the rule is valid. The head may name itself (recursion)."""
        if not (source or "").strip():
            return [Finding("SYNTAX", "The rule is empty.", "", "Write a rule or a constraint.")]
        try:
            rule = parse_rule(source)
        except RuleError as e:
            return [Finding("SYNTAX", str(e), source)]
        if rule.head is None:
            return []
        own = rule.head.relation.lower()
        found = []
        for atom in rule.atoms:
            name = atom.relation.lower()
            if name != own and name not in self.schemas:
                like = nearest(name, sorted(self.schemas))
                found.append(Finding("VOCABULARY", f"Relation '{name}' is not in the catalog.", name, like and f"Did you mean '{like}'?"))
        bound = {a.upper() for atom in rule.atoms for a in atom.args if a[:1] not in "'\"" and not a[:1].isdigit()}
        for c in rule.conditions:
            for ref in (c.left, c.right_ref):
                if ref is not None and ref.variable and ref.variable.upper() not in bound:
                    found.append(Finding("SCOPE", f"Variable '{ref.variable.upper()}' is bound by no atom of the body.", str(ref), f"Add an atom that binds it, such as some_relation({ref.variable.upper()})."))
            found += self._types(rule, c)
        return found

    def _types(self, rule: Rule, c: Condition) -> list[Finding]:
        if not c.left.variable:
            return []
        column = c.left.column.lower()
        kind = next((f.dataType for a in rule.atoms for f in self.schemas.get(a.relation.lower(), T.StructType()).fields if f.name.lower() == column), None)
        name = len(c.right) == 1 and c.right.isupper() or c.right_ref is not None
        if isinstance(kind, T.NumericType) and not c.is_number and not name and not c.right.isupper():
            return [Finding("TYPE", f"Column '{column}' is numeric ({kind.simpleString()}) but is compared with {c.right}.", str(c), f"Compare it with a number, such as {column} > 0.9")]
        if isinstance(kind, T.StringType) and not c.is_quoted and not name:
            return [Finding("TYPE", f"Column '{column}' is a string but is compared with the unquoted {c.right}.", str(c), f"Quote it: {column} = '{c.right}'")]
        return []


def diagnostics(findings: list[Finding]) -> str:
    """One text for all findings, as fed back to whoever wrote the rule."""
    if not findings:
        return "Rule is valid."
    return "\n".join(["Datalog validation errors:", *(f"  {i}: {f}" for i, f in enumerate(findings, 1))])

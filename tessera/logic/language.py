"""Plain language to rules through any text model: a callable from prompt to text."""

from __future__ import annotations

import logging
from collections.abc import Callable

from tessera.errors import RuleError
from tessera.logic.canonical import canonical
from tessera.logic.checker import Checker, diagnostics
from tessera.logic.parser import parse_rule

RETRIES = 2
_PROMPT = "Write one Datalog rule, head(X) :- relation(X), X.column > value. Give only the rule.\nRelations: {relations}\nRequest: {request}"
_log = logging.getLogger(__name__)


def compile_rule(request: str, model: Callable[[str], str], checker: Checker | None = None, retries: int = RETRIES) -> str:
    """Canonical rule text for a request. Findings of the checker go back to the model; after the last try the rule is
    taken with a warning if it parses at all."""
    relations = "; ".join(f"{n}({', '.join(s.fieldNames())})" for n, s in (checker.schemas.items() if checker else ()))
    prompt = _PROMPT.format(relations=relations or "any", request=request)
    text, findings = "", []
    for _ in range(retries + 1):
        text = model(prompt).strip().strip("`").strip()
        findings = checker.check(text) if checker else []
        if not findings:
            break
        prompt = f"{_PROMPT.format(relations=relations, request=request)}\nYour rule: {text}\n{diagnostics(findings)}"
    try:
        parse_rule(text)
    except RuleError as e:
        raise RuleError(f"the model gave no rule: {text!r}") from e
    if findings:
        _log.warning("rule accepted with findings: %s", diagnostics(findings))
    return canonical(text)

"""Rules as filters: on a finished result, and on scans.

On a result a rule is a filter by column name, with the engine's own reading of NULL and types (``compat``), or with
plain SQL semantics (``strict``). On scans the qualified conditions of rules are ordinary predicates, which Catalyst pushes
into the files.
"""

from __future__ import annotations

import logging
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import RuleError
from tessera.logic.parser import Condition, Rule

EPSILON = 2.220446049250313e-16  # doubles closer than this are equal
_log = logging.getLogger(__name__)


def _compare(left: Column, op: str, right: Column) -> Column:
    return {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "=": left == right, "!=": left != right}[op]


def field_of(schema: T.StructType, name: str) -> T.StructField | None:
    """The field of that name, exactly or else whatever the case."""
    return next((f for f in schema.fields if f.name == name), None) or next((f for f in schema.fields if f.name.lower() == name.lower()), None)


def compat_predicate(field: T.StructField, condition: Condition) -> Column | None:
    """NULL passes; NaN fails; only DOUBLE and STRING columns are tested, strings only for (in)equality. None: no test."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DoubleType):
        try:
            value = float(condition.right)
        except ValueError as e:
            raise RuleError(f"{field.name} is a number and cannot be compared with {condition.right}") from e
        if condition.op in ("=", "!="):
            close = F.abs(column - F.lit(value)) < EPSILON
            test = close if condition.op == "=" else ~close
        else:
            test = _compare(column, condition.op, F.lit(value))
        return column.isNull() | (test & ~F.isnan(column))
    if isinstance(field.dataType, T.StringType) and condition.op in ("=", "!="):
        return column.isNull() | _compare(column, condition.op, F.lit(condition.text_value))
    if not isinstance(field.dataType, (T.DoubleType, T.StringType)):
        _log.warning("rule condition %s is not applied to %s of type %s", condition, field.name, field.dataType.simpleString())
    return None


def literal(condition: Condition) -> Column | None:
    """The typed literal of a pushable condition: with a point a double, else an integer, else a quoted string."""
    if condition.is_number:
        return F.lit(float(condition.right)) if any(c in condition.right for c in ".eE") else F.lit(int(condition.right))
    return F.lit(condition.text_value) if condition.is_quoted else None


def strict_predicate(field: T.StructField, condition: Condition) -> Column | None:
    """Plain SQL: NULL fails, every type is tested, NaN fails."""
    value = literal(condition)
    if value is None:
        return None
    column = F.col(f"`{field.name}`")
    test = _compare(column, condition.op, value)
    return test & ~F.isnan(column) if isinstance(field.dataType, (T.DoubleType, T.FloatType)) else test


def result_predicate(schema: T.StructType, rules: list[Rule], mode: str = "compat") -> Column | None:
    """All conditions of all rules whose column the result has; a rule none of whose columns is there does nothing."""
    make = compat_predicate if mode == "compat" else strict_predicate
    tests = []
    for rule in rules:
        for condition in rule.conditions:
            field = field_of(schema, condition.left.column)
            if field is not None and condition.right_ref is None and (test := make(field, condition)) is not None:
                tests.append(test)
    return reduce(and_, tests) if tests else None


def guard_result(frame: DataFrame, rules: list[Rule], mode: str = "compat") -> DataFrame:
    """The rows of a finished result that every applicable rule lets pass."""
    test = result_predicate(frame.schema, rules, mode)
    return frame if test is None else frame.filter(test)


def scan_predicates(schema: T.StructType, rules: list[Rule], table: str = "", scope: str = "any") -> list[Column]:
    """Pushable predicates for a table: qualified conditions of rules with a head, on columns the table has.

    scope "any" ignores which relation the rule names, "relation" takes only rules whose body names the table.
    """
    out = []
    for rule in rules:
        if rule.head is None or (scope == "relation" and table.lower() not in {a.relation.lower() for a in rule.atoms}):
            continue
        for condition in rule.conditions:
            field = field_of(schema, condition.left.column) if condition.left.variable else None
            if field is not None and condition.right_ref is None and (value := literal(condition)) is not None:
                out.append(_compare(F.col(f"`{field.name}`"), condition.op, value))
    return out


def guard_scan(frame: DataFrame, rules: list[Rule], table: str = "", scope: str = "any") -> DataFrame:
    """The table below all scans of it: filtered by every pushable predicate."""
    tests = scan_predicates(frame.schema, rules, table, scope)
    return frame.filter(reduce(and_, tests)) if tests else frame

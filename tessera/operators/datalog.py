"""Evaluation of rules over relations: joins of the body, and fixpoints of recursive rules.

An atom with as many arguments as its relation has columns binds them by place: equal variables join, constants filter. An
atom with one argument over a wider relation names its row: ``P.col`` is a column of it, and atoms of one row variable
join on all columns they share. Keys are compared by their own types, and NULL keys join nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CrossProductError, FixpointError, RuleError
from tessera.logic.parser import Atom, Condition, Rule
from tessera.operators.guards import _compare, field_of, literal
from tessera.sources.shared import Store

MAX_ROUNDS = 100
CROSS_LIMIT = 10_000  # rows of a product without any key or comparison

Relations = Callable[[str], DataFrame]


def natural_join(left: DataFrame, right: DataFrame, limit: int = CROSS_LIMIT) -> DataFrame:
    """Inner equi-join on all shared columns: left's columns, then right's others. Without shared columns a product, which
    is refused if it may be larger than limit (both sides are counted up to the limit only)."""
    shared = [c for c in left.columns if c in right.columns]
    if shared:
        return left.join(right, shared).select(*left.columns, *(c for c in right.columns if c not in shared))
    sizes = [x.limit(limit + 1).count() for x in (left, right)]
    if sizes[0] * sizes[1] > limit:
        raise CrossProductError(f"a product of relations without a shared column may have more than {limit} rows")
    return left.crossJoin(right)


def _by_place(atom: Atom, frame: DataFrame) -> DataFrame:
    """Columns named by variable; repeated variables and constants filter."""
    tests, first = [], {}
    for arg, column in zip(atom.args, frame.columns, strict=True):
        col = F.col(f"`{column}`")
        if arg[:1] in "'\"":
            tests.append(col == F.lit(arg.strip("'\"")))
        elif arg[:1].isdigit() or arg[:1] == "-":
            tests.append(col == F.lit(float(arg) if "." in arg else int(arg)))
        elif arg == "_":
            continue
        elif arg in first:
            tests.append(col == first[arg])
        else:
            first[arg] = col
    frame = frame.filter(reduce(lambda a, b: a & b, tests)) if tests else frame
    return frame.select(*(c.alias(v) for v, c in first.items()))


def _row_mode(rule: Rule, frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Join rows named by variables; comparisons between variables are join conditions."""
    rows: dict[str, DataFrame] = {}
    for variable, frame in frames:
        rows[variable] = natural_join(rows[variable], frame) if variable in rows else frame
    taken: dict[str, int] = {}
    for frame in rows.values():
        for c in frame.columns:
            taken[c] = taken.get(c, 0) + 1
    named: dict[tuple[str, str], str] = {(v, c): c if taken[c] == 1 else f"{v}_{c}" for v, frame in rows.items() for c in frame.columns}

    def column(variable: str | None, name: str) -> Column | None:
        found = [n for (v, c), n in named.items() if c.lower() == name.lower() and (variable is None or v == variable)]
        return F.col(f"`{found[0]}`") if found else None

    def test(c: Condition) -> tuple[set[str], Column]:
        left = column(c.left.variable, c.left.column)
        right = column(c.right_ref.variable, c.right_ref.column) if c.right_ref else literal(c)
        if left is None or right is None:
            raise RuleError(f"{c} names no column of the body")
        owners = {c.left.variable or next(v for (v, n) in named if n.lower() == c.left.column.lower())} | ({c.right_ref.variable} if c.right_ref else set())
        return owners, _compare(left, c.op, right)

    tests = [test(c) for c in rule.conditions]
    out, bound = None, set()
    for variable, frame in rows.items():
        frame = frame.select(*(F.col(f"`{c}`").alias(named[variable, c]) for c in frame.columns))
        own = [t for who, t in tests if who == {variable}]
        frame = reduce(lambda f, t: f.filter(t), own, frame)
        if out is None:
            out, bound = frame, {variable}
            continue
        bound.add(variable)
        across = [t for who, t in tests if len(who) > 1 and who <= bound and variable in who]
        out = out.join(frame, reduce(lambda a, b: a & b, across)) if across else natural_join(out, frame)
    return out


def evaluate(rule: Rule, relations: Relations, override: dict[int, DataFrame] | None = None) -> DataFrame:
    """Rows of a rule's body. override: other rows for the atom at that place of the body."""
    if rule.head is None:
        raise RuleError("a bare constraint has no body; name the relation in a rule")
    frames = [(a, (override or {}).get(i, None) if (override or {}).get(i) is not None else relations(a.relation)) for i, a in enumerate(rule.atoms)]
    if not frames:
        raise RuleError(f"no relation in the body of {rule.source!r}")
    if all(len(a.args) == len(f.columns) and (len(f.columns) > 1 or not rule.conditions) for a, f in frames):
        bound = [_by_place(a, f) for a, f in frames]
        out = reduce(natural_join, bound)
        for c in rule.conditions:
            field = field_of(out.schema, c.left.column)
            right = literal(c) if literal(c) is not None else F.col(c.right)
            if field is None:
                raise RuleError(f"{c} names no variable of the body")
            out = out.filter(_compare(F.col(f"`{field.name}`"), c.op, right))
        missing = [v for v in rule.head.args if v not in out.columns]
        if missing:
            raise RuleError(f"head variables {missing} are not bound")
        return out.select(*rule.head.args).distinct() if rule.head.args else out
    if all(len(a.args) <= 1 for a, _ in frames):
        return _row_mode(rule, [(a.args[0] if a.args else a.relation, f) for a, f in frames])
    raise RuleError(f"atoms of {rule.source!r} fit neither their relations' columns nor row variables")


def fixpoint(spark: SparkSession, rules: list[Rule], relations: Relations, most: int = MAX_ROUNDS) -> DataFrame:
    """All rows of the rules' common head."""
    heads = {r.head.relation.lower() for r in rules if r.head}
    if len(heads) != 1:
        raise RuleError("a fixpoint needs rules of one head")
    return fixpoints(spark, rules, relations, most)[heads.pop()]


def fixpoints(spark: SparkSession, rules: list[Rule], relations: Relations, most: int = MAX_ROUNDS) -> dict[str, DataFrame]:
    """All rows of every head of rules that use each other, semi-naive: each round joins only the rows that were new in the last one.

    Rounds are written to the shared folder, which cuts the lineage. Raises FixpointError if rows still come after that
    many rounds; a cyclic graph settles, as known rows are no news.
    """
    columns: dict[str, list[str]] = {}
    for r in rules:
        columns.setdefault(r.head.relation.lower(), list(r.head.args))
    own = lambda a: a.relation.lower() in columns
    seeds: dict[str, list[DataFrame]] = {h: [] for h in columns}
    for r in rules:
        if not any(own(a) for a in r.atoms):
            seeds[r.head.relation.lower()].append(evaluate(r, relations))
    for head in columns:
        try:
            seeds[head].append(relations(head))
        except (KeyError, RuleError):
            pass
    if not any(seeds.values()):
        raise RuleError(f"{', '.join(sorted(columns))}: no rows to begin with: add facts or a rule that is not recursive")
    store = Store(spark, "fixpoint")
    known: dict[str, DataFrame] = {}
    for head, frames in seeds.items():
        if frames:
            known[head] = store.put(f"{head}-0", reduce(DataFrame.union, [f.toDF(*columns[head]) for f in frames]).distinct())
    delta, parts = dict(known), {h: [f"{h}-0"] for h in known}
    for k in range(1, most + 1):
        made: dict[str, list[DataFrame]] = {}
        for r in rules:
            for i, a in enumerate(r.atoms):
                if own(a) and a.relation.lower() in delta:
                    others = {j: known.get(b.relation.lower()) for j, b in enumerate(r.atoms) if own(b) and j != i}
                    if all(f is not None for f in others.values()):
                        head = r.head.relation.lower()
                        made.setdefault(head, []).append(evaluate(r, relations, {**others, i: delta[a.relation.lower()]}).toDF(*columns[head]))
        delta = {}
        for head, frames in made.items():
            fresh = reduce(DataFrame.union, frames).distinct()
            if head in known:
                fresh = fresh.join(known[head], columns[head], "left_anti")
            fresh = store.put(f"{head}-{k}", fresh)
            if not fresh.isEmpty():
                delta[head] = fresh
        if not delta:
            return known
        for head, fresh in delta.items():
            parts.setdefault(head, []).append(f"{head}-{k}")
            known[head] = spark.read.schema(fresh.schema).parquet(*(f"{store.path}/{p}" for p in parts[head]))
    raise FixpointError(f"{', '.join(sorted(delta))} still grows after {most} rounds")

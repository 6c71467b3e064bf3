"""The engine's session: SQL under rules, models as functions, provenance, monitoring."""

from __future__ import annotations

import logging
import os
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.control.packs import Hub, Pack
from tessera.control.placement import DevicePool, Slot
from tessera.errors import EngineError, RuleError, TableError
from tessera.functions import spatial, vectors
from tessera.hitl import explainer
from tessera.hitl.monitor import Anomaly, Monitor
from tessera.logic.checker import Checker
from tessera.logic.language import compile_rule
from tessera.logic.parser import Rule, parse_rule, used_together
from tessera.models.operators import LinearOperator, OnnxOperator, Operator, Registry, checked_arguments, model_features, onnx_inputs, onnx_udf, predict, version_key
from tessera.operators import datalog, provenance
from tessera.operators.guards import guard_result, guard_scan
from tessera.plans import pareto
from tessera.plans.statements import Call, Constraints, Predict, parse_call, parse_constraints, parse_predict
from tessera.shipping import ensure_shipped
from tessera.sources.catalog import Catalog
from tessera.sources.versioned import VersionedTable

_log = logging.getLogger(__name__)
REFINEMENT = "__refinement_patch__"


@dataclass
class Config:
    provenance: str = "polynomial"  # boolean, probability, polynomial, adaptive, none
    rule_mode: str = "compat"  # compat, strict
    scan_scope: str = "any"  # any, relation
    guard_predictions: bool = False
    constrained_output: str = "append"  # append the score to the rows, or replace them by it

    @classmethod
    def from_toml(cls, path: str) -> Config:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        known = {k: v for k, v in data.get("session", data).items() if k in cls.__dataclass_fields__}
        return cls(**known)


@dataclass
class QueryResult:
    """A lazy result. Anomalies and reasoning are computed when asked for."""

    frame: DataFrame
    mode: str
    monitor: Monitor = field(default_factory=Monitor)
    model: str | None = None

    def anomalies(self) -> list[Anomaly]:
        return self.monitor.inspect(self.frame)

    def reasoning(self, limit: int = explainer.DETAIL_ROWS) -> list[str]:
        return explainer.reasoning(self.frame, self.mode, limit)

    def observed(self) -> tuple[DataFrame, Callable[[], list[Anomaly]]]:
        """The rows with the monitor riding along, and its verdict for after the action: no second pass."""
        from tessera.hitl.monitor import judge

        frame, seen, own = self.monitor.attach(self.frame)
        return frame, lambda: judge(seen.get, own, self.monitor.low, self.monitor.most)


class Session:
    def __init__(self, spark: SparkSession, config: Config | None = None, catalog: str | None = None, devices: list[Slot] | None = None, hub: Hub | str | None = None):
        ensure_shipped(spark)
        self.spark, self.config = spark, config or Config()
        self.rules: dict[str, Rule] = {}
        self.tables: dict[str, DataFrame] = {}
        self.facts: dict[str, DataFrame] = {}
        self.registry = Registry()
        self.devices = DevicePool(devices or [Slot("cpu-0", "cpu")])
        self.last_sql: str | None = None
        self.hub = Hub(hub) if isinstance(hub, str) else hub
        self.catalog = Catalog(catalog) if catalog else None
        self._register_functions()
        if self.catalog:
            for name, path in self.catalog.data["tables"].items():
                self.register_table(name, str(path), remember=False)
            for name, source in self.catalog.data["rules"].items():
                self.register_rule(name, str(source), remember=False)
            for entry in self.catalog.data["models"].values():
                self.load_model(**entry, remember=False)

    # tables
    def register_table(self, name: str, source: str | DataFrame, remember: bool = True) -> None:
        """A table by path (any Spark file system) or DataFrame; it is read when a query needs it."""
        if isinstance(source, str) and VersionedTable(self.spark, source).version:
            frame = VersionedTable(self.spark, source).read()
        else:
            frame = self.spark.read.parquet(source) if isinstance(source, str) else source
        self.tables[name.lower()] = frame
        self._view(name.lower())
        if remember and self.catalog and isinstance(source, str):
            self.catalog.put("tables", name.lower(), source)

    def _view(self, name: str) -> None:
        guard_scan(self.tables[name], list(self.rules.values()), name, self.config.scan_scope).createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        if name.lower() not in self.tables:
            raise TableError(f"no table {name!r}")
        return self.tables[name.lower()]

    def insert(self, name: str, path: str, rows: DataFrame) -> tuple[int, int]:
        out = VersionedTable(self.spark, path).insert(rows)
        self.register_table(name, path)
        return out

    def delete(self, name: str, path: str, predicate: str) -> tuple[int, int]:
        out = VersionedTable(self.spark, path).delete(predicate)
        self.register_table(name, path)
        return out

    # rules
    def register_rule(self, name: str, source: str, remember: bool = True) -> Rule:
        rule = parse_rule(source, name)
        self.rules[name] = rule
        for t in self.tables:
            self._view(t)
        if remember and self.catalog:
            self.catalog.put("rules", name, source)
        return rule

    def remove_rule(self, name: str) -> bool:
        there = self.rules.pop(name, None) is not None
        for t in self.tables:
            self._view(t)
        if self.catalog:
            self.catalog.remove("rules", name)
        return there

    def checker(self) -> Checker:
        return Checker({n: f.schema for n, f in {**self.tables, **self.facts}.items()})

    def register_rule_from_text(self, name: str, request: str, model: Callable[[str], str]) -> Rule:
        return self.register_rule(name, compile_rule(request, model, self.checker()))

    def add_facts(self, relation: str, rows: DataFrame) -> None:
        """More rows for a relation, beside the table of that name."""
        key = relation.lower()
        self.facts[key] = self.facts[key].unionByName(rows) if key in self.facts else rows

    def relation(self, name: str) -> DataFrame:
        key = name.lower()
        found = [x[key] for x in (self.tables, self.facts) if key in x]
        if not found:
            raise RuleError(f"no relation {name!r}")
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def evaluate(self, rule: str | Rule) -> DataFrame:
        """Rows of a rule: a join of its body, a fixpoint if it is recursive, a filter for a bare constraint."""
        found = rule if isinstance(rule, Rule) else self.rules.get(rule) or parse_rule(rule)
        if found.head is None:
            owners = [n for n, f in {**self.tables, **self.facts}.items() if {c.lower() for c in found.columns} <= {c.lower() for c in f.columns}]
            if not owners:
                raise RuleError(f"no relation has the columns {found.columns}")
            return guard_result(self.relation(owners[0]), [found], self.config.rule_mode)
        known = [*(r for r in self.rules.values() if r.source != found.source), found]
        head = found.head.relation.lower()
        together = used_together(known, head)
        if not together and not found.is_recursive:
            return datalog.evaluate(found, self._derived(found))
        together |= {head}
        rules = [r for r in known if r.head and r.head.relation.lower() in together]
        return datalog.fixpoints(self.spark, rules, self._derived(found, together))[head]

    def _derived(self, rule: Rule, together: set[str] = frozenset()) -> Callable[[str], DataFrame]:
        """Relations by name: tables and facts, and for other names the rows of the rules of that head."""

        def relation(name: str) -> DataFrame:
            key = name.lower()
            if key not in self.tables and key not in self.facts and key not in together:
                of = [r for r in self.rules.values() if r.head and r.head.relation.lower() == key and r.source != rule.source]
                if of:
                    parts = [self.evaluate(r) for r in (of[:1] if used_together(list(self.rules.values()), key) else of)]
                    return reduce(lambda x, y: x.union(y.toDF(*x.columns)), parts)
            return self.relation(name)

        return relation

    def evaluate_all(self) -> dict[str, DataFrame]:
        """Rows of every rule, by name; their columns may differ."""
        return {n: self.evaluate(r) for n, r in self.rules.items()}

    # models
    def register_model(self, operator: Operator, model_id: str | None = None, size: int = 0) -> str:
        model_id = model_id or str(uuid.uuid4())
        self.registry.register(operator, model_id, datetime.now(timezone.utc).isoformat(timespec="seconds"), size)
        self._register_udf(operator.function_id)
        self._models_view()
        return model_id

    def load_model(self, function_id: str, path: str, remember: bool = True, **options) -> str:
        """A model file as a function; a session with a catalog loads it again by its path."""
        operator = OnnxOperator.from_file(function_id, path, **options)
        if remember and self.catalog:
            self.catalog.put("models", f"{function_id}@{operator.version}", {"function_id": function_id, "path": path} | options)
        return self.register_model(operator, size=len(operator.content))

    def unregister_model(self, model_id: str) -> None:
        if self.catalog and model_id in self.registry.models:
            self.catalog.remove("models", "{name}@{version}".format(**self.registry.models[model_id]))
        self.registry.unregister(model_id)
        self._models_view()

    def _models_view(self) -> None:
        self.spark.createDataFrame(list(self.registry.models.values()), spatial.SCHEMAS["__ai_models"]).createOrReplaceTempView("__ai_models")

    def _register_udf(self, function_id: str) -> None:
        """The latest version as a SQL function: an Arrow UDF for model files, a SQL expression for native models."""
        operator = self.registry.latest(function_id)
        if isinstance(operator, LinearOperator):
            names = [f"x{i}" for i in range(len(operator.weights))]
            total = " + ".join([f"double({operator.bias!r})", *(f"double({w!r}) * cast(cast({n} AS float) AS double)" for w, n in zip(operator.weights, names, strict=True))])
            body = f"1.0D / (1.0D + exp(-({total})))" if operator.logistic else total
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function_id}({', '.join(f'{n} DOUBLE' for n in names)}) RETURNS DOUBLE RETURN {body}")
            return
        inner = f"__{function_id}_rows"
        self.spark.udf.register(inner, onnx_udf(operator.content))
        arity = len(operator.features) if operator.features else onnx_inputs(operator.content)
        names = [f"x{i}" for i in range(arity)]
        array = ", ".join(f"cast({n} AS float)" for n in names)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function_id}({', '.join(f'{n} DOUBLE' for n in names)}) RETURNS DOUBLE RETURN {inner}(array({array}))")

    def _register_functions(self) -> None:
        self.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
        point = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION spatial_distance(a {point}, b {point}) RETURNS DOUBLE RETURN sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))")
        event = "ARRAY<STRUCT<label: STRING, start: DOUBLE, end: DOUBLE, confidence: DOUBLE>>"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION audio_tempo(e {event}) RETURNS DOUBLE RETURN CASE WHEN size(e) >= 2 AND array_max(e.start) > array_min(e.start) THEN 60D * (size(e) - 1) / (array_max(e.start) - array_min(e.start)) END")

    # packs
    def load_pack(self, pack: Pack | str) -> dict[str, int]:
        pack = Pack.load(pack) if isinstance(pack, str) else pack
        for r in pack.rules:
            self.register_rule(r["name"], r["source"])
        for m in pack.models:
            self._load_packed(pack, m)
        return {"rules": len(pack.rules), "models": len(pack.models)}

    def _load_packed(self, pack: Pack, entry: dict) -> str:
        """A model of a pack: native by its weights, or a file by its path (as it stands, or beside the pack)."""
        if "weights" in entry:
            return self.register_model(LinearOperator(**entry))
        name, path = entry.get("name") or entry.get("function_id"), entry.get("artifact_path")
        if not name or not path:
            raise EngineError(f"pack {pack.name!r} has a model without weights and without artifact_path: {entry}")
        found = next((p for p in (path, os.path.join(pack.folder, path)) if os.path.isfile(p)), None)
        if found is None:
            raise EngineError(f"pack {pack.name!r}: no model file {path!r}")
        operator = OnnxOperator.from_file(name, found, version=pack.version, latency_ms=float(entry.get("avg_latency_ms", 1.0)), accuracy=float(entry.get("accuracy", 0.95)), features=entry.get("features"))
        wanted = entry.get("num_features")
        if wanted is not None and onnx_inputs(operator.content) != int(wanted):
            raise EngineError(f"pack {pack.name!r}: {name} takes {onnx_inputs(operator.content)} numbers, not {wanted}")
        return self.register_model(operator, size=len(operator.content))

    # queries
    def sql(self, text: str) -> QueryResult:
        """Run a statement under the rules; the result is lazy, but for row counts that an adaptive or constrained
        query depends on."""
        statement = parse_predict(text)
        if statement is not None:
            return self.predict(statement)
        call = parse_call(text)
        if call is not None:
            return QueryResult(self.call(call), "none")
        query, constraints = parse_constraints(text)
        self.last_sql = text
        frame, model = self.spark.sql(query), None
        if constraints is not None:
            frame, model = self._constrained(frame, constraints)
        frame = guard_result(frame, list(self.rules.values()), self.config.rule_mode)
        return self._finish(frame, model)

    def _finish(self, frame: DataFrame, model: str | None = None) -> QueryResult:
        mode = self.config.provenance
        if mode == "adaptive":
            mode = provenance.adaptive_mode(frame.limit(provenance.PROBABILITY_ROWS + 1).count())
        return QueryResult(frame if mode == "none" else provenance.attach(frame, mode), mode, model=model)

    def predict(self, statement: Predict) -> QueryResult:
        operator = self.registry.latest(statement.model)
        if statement.table.lower() not in self.tables:
            raise TableError(f"no table {statement.table!r}")
        frame = predict(self.spark.table(statement.table), operator, statement.output, statement.kind)
        if self.config.guard_predictions:
            frame = guard_result(frame, list(self.rules.values()), self.config.rule_mode)
        return self._finish(frame, operator.function_id)

    def _constrained(self, frame: DataFrame, constraints: Constraints) -> tuple[DataFrame, str | None]:
        """Score the rows with the model the constraints choose; without a feasible model the rows are the result."""
        operators = {f"{o.function_id}@{o.version}": o for o in self.registry.operators.values()}
        if not operators:
            return frame, None
        speeds = {k: self.devices.speed(getattr(o, "device_affinity", None)) for k, o in operators.items()}
        choice = lambda rows: pareto.choose([pareto.plan_of(o, rows, speeds[k]) for k, o in operators.items()], constraints)
        chosen = choice(0)
        # latencies grow alike with the rows, so only a bound on the latency can make the choice depend on their number
        if constraints.max_latency_ms is not None and chosen is not None:
            most = pareto.rows_within(constraints.max_latency_ms, [o.latency_ms / speeds[k] for k, o in operators.items()])
            if most is not None:
                chosen = choice(frame.limit(most + 1).count())
        if chosen is None:
            return frame, None
        operator = operators[chosen.plan_id]
        try:
            score = operator.score(checked_arguments(frame, model_features(operator, frame))).alias("score")
        except (ValueError, KeyError) as e:
            _log.warning("%s does not fit the rows: %s", chosen.plan_id, e)
            return frame, None
        return (frame.select(score) if self.config.constrained_output == "replace" else frame.select("*", score)), chosen.plan_id

    def call(self, call: Call) -> DataFrame:
        """Statements that act on the session: packs of its hub, and models made of others."""
        options = dict(call.options)
        if call.function.startswith("hub_"):
            if self.hub is None:
                raise EngineError("the session has no hub")
            if call.function == "hub_search":
                found = [(p.name, p.version, p.description) for p in self.hub.search(call.target)]
                return self.spark.createDataFrame(found, "name string, version string, description string")
            done = self.load_pack(self.hub.install(call.target))
            return self.spark.createDataFrame([(f"{call.target}: {done['rules']} rule(s), {done['models']} model(s)",)], f"`{call.alias}` string")
        old, table = self.registry.latest(call.target), options.pop("target_table", None)
        if not isinstance(table, str):
            raise EngineError(f"{call.function} needs target_table => 'name'")
        rows = self.table(table)
        if call.function == "distill_model":
            from tessera.models.distill import distill

            made = distill(rows, old, str(options.get("name", f"{call.target}_student")), old.features or model_features(old, rows), epochs=int(options.get("epochs", 50)), latency_ms=float(options.get("target_latency_ms", 0.1))).student
        else:
            from tessera.models.finetune import finetune

            version = str(options.get("version", f"{version_key(old.version)[0][1] + 1}.0.0"))
            made = finetune(rows, old, str(options.get("label", "label")), version, epochs=int(options.get("epochs", 5))).model
        model_id = self.register_model(made)
        return self.spark.createDataFrame([(model_id, made.function_id, made.version, float(made.accuracy))], f"`{call.alias}` string, name string, version string, accuracy double")

    def refine(self, request: str, model: Callable[[str], str]) -> QueryResult:
        """Add a rule made of the request and run the last query again."""
        if self.last_sql is None:
            raise EngineError("no query to refine")
        self.register_rule_from_text(REFINEMENT, request, model)
        return self.sql(self.last_sql)

    def explain(self, result: QueryResult, level: str = "coarse") -> explainer.Explanation:
        models = [(m["name"], m["version"]) for m in self.registry.models.values()]
        rules = {n: f"{r.source} (class {r.klass})" for n, r in self.rules.items()}
        return explainer.explain(result.frame, rules, models, result.mode, level, self.devices.summary())


__all__ = ["Config", "QueryResult", "Session", "vectors"]

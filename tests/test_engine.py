"""Session, models, planner, provenance, monitoring, storage, control plane: the known cases."""

import json
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.control import limits, placement, policy, transactions
from tessera.control.packs import Hub, Pack
from tessera.errors import EngineError, ModelNotFound, TableError, VersionConflict
from tessera.functions import spatial, vectors
from tessera.hitl import explainer, lineage, triage
from tessera.hitl.monitor import Monitor
from tessera.models.finetune import finetune
from tessera.models.operators import LinearOperator, OnnxOperator, Registry, export_onnx, version_key
from tessera.operators import provenance as prov
from tessera.plans import pareto
from tessera.plans.statements import Constraints, parse_constraints, parse_predict
from tessera.session import Config, Session
from tessera.sources.ingest import from_arrow_stream, ingest_csv, pretty, to_arrow_stream
from tessera.sources.versioned import VersionedTable
from tessera.streaming.guarded import guard_stream, monitor_stream

COLUMNS = "transaction_id string, amount double, fraud_prob double, region string, hour_of_day long"
ROWS = [(f"T{i:02d}", 500.0 * i, (i * 37 % 100) / 100, ("US", "EU", "APAC")[i % 3], i % 24) for i in range(25)]


@pytest.fixture()
def session(spark):
    s = Session(spark, Config(provenance="none"))
    s.register_table("transactions", spark.createDataFrame(ROWS, COLUMNS))
    return s


def test_rules_filter_results_after_limits_and_aggregates(session):
    session.register_rule("risk", "fraud_prob > 0.80")
    want = [r for r in ROWS if r[2] > 0.8]
    assert session.sql("SELECT * FROM transactions").frame.count() == len(want)
    assert session.sql("SELECT count(*) AS c FROM transactions").frame.first()["c"] == 25
    top = sorted(ROWS, key=lambda r: -r[1])[:5]
    assert session.sql("SELECT * FROM transactions ORDER BY amount DESC LIMIT 5").frame.count() == sum(r[2] > 0.8 for r in top)
    session.remove_rule("risk")
    session.register_rule("scan", "r(X) :- transactions(X), X.fraud_prob > 0.80.")
    assert session.sql("SELECT count(*) AS c FROM transactions").frame.first()["c"] == len(want)


def test_predict_and_inline_functions(session):
    session.register_model(LinearOperator("acc", [1e-5, 3.0, 0.1], -2.0, features=["amount", "fraud_prob", "hour_of_day"]))
    z = lambda r: 1 / (1 + np.exp(-(1e-5 * r[1] + 3 * np.float32(r[2]) + 0.1 * r[4] - 2)))
    got = session.sql("PREDICT CLASS OF fraud FROM transactions WITH (model = 'acc')").frame
    assert got.schema["prediction_fraud"].dataType.simpleString() == "bigint"
    assert {r["transaction_id"]: r["prediction_fraud"] for r in got.collect()} == {r[0]: int(z(r) >= 0.5) for r in ROWS}
    inline = session.sql("SELECT transaction_id, acc(amount, fraud_prob, hour_of_day) AS p FROM transactions").frame.collect()
    assert all(abs(r["p"] - z(next(x for x in ROWS if x[0] == r["transaction_id"]))) < 1e-6 for r in inline)
    with pytest.raises(ModelNotFound):
        session.sql("PREDICT VALUE OF fraud FROM transactions WITH (model = 'none')")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_onnx(weights, bias):
    """sigmoid(x W + b), as the bytes of a model file."""
    node = lambda op, ins, out: b"".join([*(field(1, i.encode()) for i in ins), field(2, out.encode()), field(4, op.encode())])
    tensor = lambda name, dims, data: b"".join([*(field(1, d) for d in dims), field(2, 1), field(8, name.encode()), field(9, struct.pack(f"<{len(data)}f", *data))])
    dim = lambda d: field(1, field(1, d) if isinstance(d, int) else field(2, d.encode()))
    value = lambda name, dims: field(1, name.encode()) + field(2, field(1, field(1, 1) + field(2, b"".join(dim(d) for d in dims))))
    n = len(weights)
    graph = b"".join([
        field(1, node("MatMul", ["x", "w"], "m")), field(1, node("Add", ["m", "b"], "a")), field(1, node("Sigmoid", ["a"], "y")), field(2, b"g"),
        field(5, tensor("w", [n, 1], weights)), field(5, tensor("b", [1], [bias])), field(11, value("x", ["n", n])), field(12, value("y", ["n", 1])),
    ])
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_onnx_model_matches_the_formula(session, tmp_path):
    path = tmp_path / "m.onnx"
    path.write_bytes(tiny_onnx([1e-5, 3.0, 0.1], -2.0))
    session.load_model("deep", str(path), features=["amount", "fraud_prob", "hour_of_day"])
    session.register_model(LinearOperator("flat", [1e-5, 3.0, 0.1], -2.0, features=["amount", "fraud_prob", "hour_of_day"]))
    both = session.sql("SELECT deep(amount, fraud_prob, hour_of_day) AS a, flat(amount, fraud_prob, hour_of_day) AS b FROM transactions").frame.collect()
    assert len(both) == 25 and all(abs(r["a"] - r["b"]) < 1e-5 for r in both)
    scored = session.sql("PREDICT VALUE OF x FROM transactions WITH (model = 'deep')").frame
    assert scored.count() == 25 and isinstance(session.registry.latest("deep"), OnnxOperator)


def test_statements():
    assert parse_constraints("SELECT * FROM HighRisk WITH (max_latency_ms = 50, min_accuracy = 0.95)") == ("SELECT * FROM HighRisk", Constraints(50.0, 0.95))
    assert parse_constraints("WITH x AS (SELECT 1) SELECT * FROM x")[1] is None
    assert parse_constraints("SELECT 1 with (max_cost=abc, odd = 1)") == ("SELECT 1", Constraints())
    p = parse_predict("predict value of risk from t")
    assert (p.kind, p.column, p.table, p.model, p.output) == ("value", "risk", "t", "default", "prediction_risk")
    assert parse_predict("SELECT 1") is None
    with pytest.raises(EngineError):
        parse_predict("PREDICT SOMETHING")


def test_planner(session):
    plans = [pareto.Plan("p", 7, 0.6, 0.2), pareto.Plan("q", 31, 0.93, 0.2), pareto.Plan("r", 31, 0.6, 0.4), pareto.Plan("s", 8, 0.6, 0.1)]
    assert [p.plan_id for p in pareto.frontier(plans)] == ["p", "q", "s"]
    assert pareto.choose(plans, Constraints(min_accuracy=0.7)).plan_id == "q" and pareto.choose(plans, Constraints(max_latency_ms=3)) is None
    for name, ms, acc in (("slow", 5.0, 0.95), ("quick", 0.5, 0.75)):
        session.register_model(LinearOperator(name, [1.0], features=["fraud_prob"], latency_ms=ms, accuracy=acc))
    assert session.sql("SELECT * FROM transactions WITH (max_latency_ms = 50)").model == "quick@1.0.0"
    assert session.sql("SELECT * FROM transactions WITH (min_accuracy = 0.9)").model == "slow@1.0.0"
    none = session.sql("SELECT * FROM transactions WITH (min_accuracy = 0.999)")
    assert none.model is None and none.frame.count() == 25


def test_versions_are_compared_as_numbers():
    r = Registry()
    for v in ("9.0.0", "10.0.0", "10.0.0-rc.1"):
        r.register(LinearOperator("f", [1.0], version=v), v)
    assert r.latest("f").version in ("10.0.0", "10.0.0-rc.1") and version_key("10.0.0") > version_key("9.9.9")
    r.unregister("10.0.0")
    r.unregister("10.0.0-rc.1")
    assert r.latest("f").version == "9.0.0"


def test_provenance(spark, session):
    session.config.provenance = "polynomial"
    result = session.sql("SELECT amount FROM transactions ORDER BY amount LIMIT 5")
    first = bytes(result.frame.first()["provenance"])
    assert first.hex() == "01000000000000001a0000000000000071756572795f706970656c696e653a73716c3a5b726f775f305d0100000000000000"
    assert prov.decode(first) == {"query_pipeline:sql:[row_0]": 1} and prov.encode(prov.decode(first)) == first
    assert result.reasoning(2) == ["row 0: query_pipeline:sql:[row_0]", "row 1: query_pipeline:sql:[row_1]"]
    assert [prov.adaptive_mode(n) for n in (500, 5000, 50000)] == ["polynomial", "probability", "boolean"] and prov.adaptive_mode(10**6, "polynomial") == "polynomial"
    p = spark.createDataFrame([(0.5,), (0.5,)], "p double").agg(prov.noisy_or(F.col("p")).alias("x")).first()["x"]
    assert p == 0.75
    polys = spark.createDataFrame([({"a": 1, "1": 2}, {"b": 3}), ({"b": 1}, {"a": 1})], "x map<string,bigint>, y map<string,bigint>")
    assert [r[0] for r in polys.select(prov.polynomial_text(prov.times(F.col("x"), F.col("y")))).collect()] == ["3·a⊗b ⊕ 6·b", "a⊗b"]
    assert prov.decode(b"xy") is None


def test_monitor(spark):
    low = spark.createDataFrame([(0.1,), (0.2,), (None,)], "confidence double")
    assert [a.kind for a in Monitor(most=0.6).inspect(low)] == ["low_confidence"] and Monitor().inspect(low) == []
    same = spark.createDataFrame([(0.7,), (0.7,)], "confidence double")
    assert [a.kind for a in Monitor().inspect(same)] == ["uniform"] and [a.kind for a in Monitor().inspect(same.limit(0))] == ["empty"]
    frame, seen, own = Monitor().attach(same)
    frame.collect()
    assert seen.get["n"] == 2 and own == ["confidence"]


def test_triage_and_repair(spark):
    cases = {"tensor shape mismatch": ("recoverable", "swap"), "deadline exceeded": ("recoverable", "swap"), "bad codec": ("degraded", "skip"), "OOM in allocation": ("degraded", "skip"), "who knows": ("fatal", "escalate")}
    for text, (severity, action) in cases.items():
        found, plan = triage.self_repair(text, "a", ["a", "b"])
        assert (found.severity, plan.action) == (severity, action)
    assert triage.plan_repair(triage.review("timeout"), "a", ["a"]).action == "retry"
    frame = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert triage.apply_repair(frame, triage.Repair("skip"))[0].count() == 1
    t = triage.Triage([None])
    t.decide("accept")
    assert t.complete


def test_lineage(spark):
    s = spark.createDataFrame([("txn", 2, "n2", "join", 5.0), ("txn", 1, "n1", "scan", 15.0), ("other", 1, "n1", "scan", 1.0)], lineage.SEGMENT)
    found = lineage.trace(s, "txn")
    assert (found["hops"], found["total_ms"], [p["node"] for p in found["path"]]) == (2, 20.0, ["n1", "n2"]) and lineage.trace(s, "none")["hops"] == 0
    nodes = lineage.ClusterMonitor(["a", "b"])
    nodes.isolate("a", "hot")
    assert nodes.active == ["b"] and nodes.resume("a") and nodes.active == ["a", "b"]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([(i, "r" if i < 3 else None) for i in range(6)], "id int, region string")
    assert t.create(rows) == 1
    with pytest.raises(TableError):
        t.create(rows)
    assert t.insert(spark.createDataFrame([(10, "TEST"), (11, "TEST")], "id int, region string")) == (2, 2)
    assert t.delete("region = 'TEST'") == (2, 3) and t.delete("region = 'TEST'") == (0, 3)
    assert t.read().count() == 6 and t.read(2).count() == 8 and t.read(1).count() == 6
    assert t.delete("region = 'r'") == (3, 4) and t.read().count() == 3
    assert t.update({"region": "'u'"}, "id = 5") == (1, 5) and t.read().filter("region = 'u'").count() == 1
    assert t.merge(spark.createDataFrame([(5, "m"), (99, "m")], "id int, region string"), ["id"]) == 6 and t.read().filter("region = 'm'").count() == 2
    assert t.overwrite(rows.limit(0)) == 7 and t.read().count() == 0 and t.read().columns == ["id", "region"]
    for bad in (rows.limit(0), rows.select("id")):
        with pytest.raises(TableError):
            t.insert(bad)
    with pytest.raises(TableError):
        t.read(42)


def test_updates_and_merges_rewrite_only_files_they_hit(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    part = lambda lo, hi, word: spark.createDataFrame([(i, word) for i in range(lo, hi)], "id int, word string").coalesce(1)
    t.create(part(0, 5, "a"))
    t.insert(part(5, 10, "b"))
    first, second = sorted(t._load(1)["files"]), sorted(set(t._load(2)["files"]) - set(t._load(1)["files"]))
    assert t.update({"word": "'c'"}, "id = 7") == (1, 3) and set(first) <= set(t._load(3)["files"]) and not set(second) & set(t._load(3)["files"])
    assert t.update({"word": "'c'"}, "id = 70") == (0, 3)
    assert t.merge(spark.createDataFrame([(3, "d"), (30, "d"), (None, "d")], "id int, word string"), ["id"]) == 4
    assert not set(first) & set(t._load(4)["files"])
    assert {tuple(r) for r in t.read().collect()} == {(None, "d"), (30, "d"), *((i, {3: "d", 7: "c"}.get(i, "a" if i < 5 else "b")) for i in range(10))} and t.read().count() == 12
    with pytest.raises(TableError):
        t.merge(spark.createDataFrame([(1, "x"), (1, "y")], "id int, word string"), ["id"])


def test_commits_are_first_come(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([(1,)], "id int")
    t.create(rows)
    files = t._write(rows)
    t._commit(1, files, rows.schema)
    with pytest.raises(VersionConflict):
        t._commit(1, files, rows.schema)
    log = spark.createDataFrame([(1, "committed", 10.0), (2, "aborted", 5.0), (3, "active", 1.0)], "txn_id int, state string, duration_us double")
    assert tuple(transactions.log_metrics(log).first()) == (1, 1, 0.5, 10.0)
    c = transactions.OptimisticController()
    a, b = c.begin(), c.begin()
    a.writes, b.writes = {"k"}, {"k"}
    with pytest.raises(VersionConflict):
        c.commit(a)
    c.commit(b)
    assert (a.state, b.state, transactions.advised(0.2, 0)) == ("aborted", "committed", "two_phase")


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,amount,flag\n1,2.5,true\n2,3.5,false\n")
    out = ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert [k for _, k in out.dtypes] == ["bigint", "double", "boolean"] and out.count() == 2
    with pytest.raises(TableError):
        ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    (tmp_path / "empty.csv").write_text("id,amount\n")
    with pytest.raises(TableError):
        ingest_csv(spark, str(tmp_path / "empty.csv"), str(tmp_path / "out2"))
    assert from_arrow_stream(to_arrow_stream(out)).num_rows == 2 and pretty(out).endswith("2 row(s)")


def test_catalog_is_reloaded(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    s = Session(spark, Config(provenance="none"), catalog=f"{tmp_path}/cat.json")
    s.register_table("numbers", f"{tmp_path}/t")
    s.register_rule("r", "r(X) :- numbers(X), X.id > 0.")
    again = Session(spark, Config(provenance="none"), catalog=f"{tmp_path}/cat.json")
    assert again.sql("SELECT * FROM numbers").frame.count() == 2
    again.remove_rule("r")
    assert json.loads((tmp_path / "cat.json").read_text())["rules"] == {}


def test_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert value(vectors.transe(arr(1, 0, 0), arr(0, 1, 0), arr(1, 1, 0))) == 0
    assert abs(value(vectors.transe(arr(1, 0, 0), arr(0, 1, 0), arr(0, 0, 1))) + 3**0.5) < 1e-9
    assert abs(value(vectors.transh(arr(1, 2, 0), arr(0, 1, 0), arr(0, 3, 0), arr(1, 0, 0)))) < 1e-9
    pt = lambda x, y, z: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))
    assert value(spatial.point_distance(pt(0, 0, 0), pt(1, 2, 2))) == 3
    box = lambda a, b: F.struct(*(F.lit(float(v)).alias(n) for v, e in ((a, "min"), (b, "max")) for n in (f"{e}_x", f"{e}_y", f"{e}_z")))
    assert abs(value(spatial.box_iou(box(0, 2), box(1, 3))) - 1 / 15) < 1e-9 and value(spatial.box_iou(box(0, 1), box(2, 3))) == 0
    cloud = F.array(pt(0, 0, 0), pt(2, 2, 0))
    assert tuple(value(spatial.centroid(cloud))) == (1, 1, 0) and value(spatial.centroid(F.slice(cloud, 1, 0))) is None


def test_policies_and_placement(spark):
    c = policy.PolicyCatalog()
    c.upsert("p1", "privacy", "a")
    c.upsert("p2", "cost", "b")
    assert [x[0] for x in c.changes_since(1)] == ["p2"] and c.version == 2 and c.deactivate("p1") and not c.deactivate("zz")
    assert tuple(policy.summary(c.frame(spark)).first()) == (1, 2, 3)
    d = policy.PolicyCatalog()
    assert d.apply(c.changes_since(0)) == 3 and d.apply(c.changes_since(0)) == 0
    nodes = spark.createDataFrame([("a", "core", 9000, 0, 0.5), ("b", "edge", 5000, 1, 0.4), ("c", "hybrid", 8500, 3, 0.6), ("d", "core", 9500, 1, 0.9)], "node_id string, role string, memory_mb long, accelerators int, load double")
    assert [placement.route(nodes, t, 8192).first()["node_id"] for t in ("perception", "symbolic", "mixed")] == ["b", "a", "c"]
    pool = placement.DevicePool([placement.Slot("c", "cpu"), placement.Slot("g", "cuda")])
    assert pool.request("cuda").name == "g" and pool.request("metal").name == "c" and pool.speed() == 50


def test_packs_and_hub(tmp_path, session):
    hub = Hub(str(tmp_path))
    assert [p.name for p in hub.search("PRICING")] == ["discount-review"] and [p.name for p in hub.search("owe")] == ["supplier-terms"]
    with pytest.raises(EngineError):
        hub.install("nothing")
    hub.publish(Pack("own").rule("r", "fraud_prob > 0.5").model(function_id="m", weights=[1.0], features=["fraud_prob"]))
    assert session.load_pack(hub.install("own")) == {"rules": 1, "models": 1} and "r" in session.rules


def test_packs_load_model_files_or_say_why_not(tmp_path, session):
    (tmp_path / "flat.onnx").write_bytes(export_onnx(LinearOperator("flat", [2.0, -1.0], 0.25, logistic=False)))
    entry = {"name": "flat", "artifact_path": "flat.onnx", "num_features": 2, "avg_latency_ms": 2.5, "accuracy": 0.7}
    Pack("files", version="2.1.0").model(**entry).save(str(tmp_path / "files.json"))
    assert session.load_pack(str(tmp_path / "files.json")) == {"rules": 0, "models": 1}
    assert session.registry.latest("flat").version == "2.1.0" and session.registry.latest("flat").latency_ms == 2.5
    assert session.sql("SELECT flat(3, 1) AS y").frame.first()["y"] == 5.25
    for bad in (entry | {"artifact_path": "none.onnx"}, entry | {"num_features": 3}, {"name": "neither"}):
        with pytest.raises(EngineError):
            session.load_pack(Pack("bad", models=[bad], folder=str(tmp_path)))


def test_catalog_loads_models_again(spark, tmp_path):
    (tmp_path / "m.onnx").write_bytes(export_onnx(LinearOperator("m", [1.0], 0.0)))
    first = Session(spark, catalog=str(tmp_path / "catalog.json"))
    model_id = first.load_model("m", str(tmp_path / "m.onnx"), version="3.0.0", accuracy=0.8)
    again = Session(spark, catalog=str(tmp_path / "catalog.json"))
    assert again.registry.latest("m").version == "3.0.0" and again.sql("SELECT m(0) AS p").frame.first()["p"] == 0.5
    first.unregister_model(model_id)
    assert not Session(spark, catalog=str(tmp_path / "catalog.json")).registry.models


def test_median_is_exact(spark):
    rng = np.random.default_rng(3)
    for values in ([], [4.0], [1.0, 2.0], [5.0] * 999, rng.normal(size=30001).tolist(), rng.integers(0, 9, 4000).astype(float).tolist()):
        frame = spark.createDataFrame([(v,) for v in [*values, None]], "score double")
        assert explainer.score_stats(frame, "score").first()["median"] == (float(np.median(values)) if values else 0.0)


def test_limits(spark):
    b = limits.TokenBucket(2, 1.0)
    assert [b.allow(t) for t in (0, 0, 0, 1, 1)] == [True, True, False, True, False]
    assert [limits.tier_of(k) for k in (None, "x", "sk-abc", "sk-team-1")] == [None, None, "free", "team"]
    m = limits.Meter()
    m.record("t", 5, 1.5)
    m.record("t", 1)
    assert m.read_and_reset("t") == (2, 6, 1.5) and m.read_and_reset("t") == (0, 0, 0.0)
    calls = spark.sql("SELECT id % 2 AS user_id, timestamp_seconds(id) AS ts, id AS event_id FROM range(40)")
    got = {r["event_id"]: r["allowed"] for r in limits.rate_limit(calls, 3, 0.25).collect()}
    want = {}
    for user in (0, 1):
        own = limits.TokenBucket(3, 0.25)
        want |= {i: own.allow(i) for i in range(user, 40, 2)}
    assert got == want


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(id * 60) AS ts, cast(id % 10 AS double) / 10 AS score FROM range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    from tessera.logic.parser import parse_rule

    q = guard_stream(stream, [parse_rule("r(X) :- s(X), X.score > 0.5.")]).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS c FROM kept").first()["c"] == 24
    q = monitor_stream(stream, "score").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["n"] for r in spark.sql("SELECT n FROM rates").collect()} == {10}


def test_hub_and_model_statements(spark, tmp_path):
    s = Session(spark, Config(provenance="none"), hub=str(tmp_path))
    assert [r["name"] for r in s.sql("SELECT hub_search('STREAM') AS packs").frame.collect()] == ["event-quality"]
    assert s.sql("SELECT hub_install('any/event-quality@1.0.0') AS result").frame.first()["result"].endswith("1 rule(s), 0 model(s)") and "weak" in s.rules
    for bad in ("SELECT hub_install('event-quality@9.0.0')", "SELECT hub_install('nothing')", "SELECT hub_install(nothing)", "SELECT distill_model('none', target_table => 'rows')"):
        with pytest.raises((EngineError, ModelNotFound)):
            s.sql(bad)
    (tmp_path / "event-quality.json").write_text((tmp_path / "event-quality.json").read_text().replace("< 2", "< 3"))
    with pytest.raises(EngineError, match="checksum"):
        s.hub.install("event-quality")
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2)).astype(np.float32).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2 * x[:, 1] + 0.5)))).astype(int)
    s.register_table("rows", spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label int"))
    s.register_model(LinearOperator("m", [0.0, 0.0], 0.0, features=["a", "b"], accuracy=0.9))
    told = s.sql("SELECT finetune_model('m', target_table => 'rows', epochs => 8) AS id").frame.first()
    tuned = s.registry.latest("m")
    assert told["version"] == tuned.version == "2.0.0" and abs(told["accuracy"] - np.mean((1 / (1 + np.exp(-(x @ tuned.weights + tuned.bias))) >= 0.5) == y)) < 1e-9
    w = np.zeros(3)
    full = np.column_stack([x, np.ones(3000)])
    for _ in range(60):  # the maximum of the likelihood, by hand
        p = 1 / (1 + np.exp(-full @ w))
        w += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full, full.T @ (y - p))
    assert np.allclose([*tuned.weights, tuned.bias], w, atol=1e-3)
    assert s.sql("SELECT distill_model('m', target_table => 'rows', name => 'small', target_latency_ms => 0.2)").frame.first()["name"] == "small"
    assert s.registry.latest("small").latency_ms == 0.2
    frozen = finetune(s.table("rows"), LinearOperator("m", [0.3, 0.0], 0.0, features=["a", "b"]), "label", "3.0.0", frozen=("a",)).model
    assert frozen.weights[0] == 0.3 and frozen.weights[1] < -1
    assert finetune(s.table("rows").limit(0), tuned, "label", "4.0.0").rows == 0


def test_locking_waits_and_breaks_circles():
    c = transactions.LockingController()
    one, two, three = c.begin(), c.begin(), c.begin()
    c.write(one, "a")
    c.write(two, "b")
    with pytest.raises(VersionConflict):
        c.write(three, "a", wait=False)
    assert three.state == "aborted"
    waiting = threading.Thread(target=c.write, args=(one, "b"))
    waiting.start()
    while not c.waits:
        pass
    with pytest.raises(VersionConflict):  # two waits for one, which waits for two
        c.write(two, "a")
    waiting.join(10)
    assert two.state == "aborted" and c.held == {"a": one, "b": one}
    c.commit(one)
    assert not c.held and one.writes == {"a", "b"}
    assert isinstance(transactions.controller(0.5, 10), transactions.LockingController) and isinstance(transactions.controller(0.0, 10), transactions.OptimisticController)


def test_rules_that_use_each_other(spark):
    s = Session(spark, Config(provenance="none"))
    s.add_facts("edges", spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)], "a int, b int"))
    for name, source in (("o1", "odd(A, B) :- edges(A, B)."), ("o2", "odd(A, C) :- even(A, B), edges(B, C)."), ("e1", "even(A, C) :- odd(A, B), edges(B, C)."), ("far", "far(A, B) :- even(A, B), A < 3.")):
        s.register_rule(name, source)
    edges, odd, even = {(1, 2), (2, 3), (3, 4), (4, 1), (4, 5)}, set(), set()
    while True:
        o = edges | {(a, c) for a, b in even for x, c in edges if x == b}
        e = {(a, c) for a, b in o for x, c in edges if x == b}
        if (o, e) == (odd, even):
            break
        odd, even = o, e
    rows = lambda rule: {tuple(r) for r in s.evaluate(rule).collect()}
    assert rows("o2") == odd and rows("e1") == even
    assert rows("far") == {(a, b) for a, b in even if a < 3}

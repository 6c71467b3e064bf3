"""Registered queries of the engine over the star-schema tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.control import limits, placement, policy, transactions
from tessera.control.packs import Hub
from tessera.functions import estimates, spatial, vectors
from tessera.hitl import explainer, lineage, monitor, triage
from tessera.logic.canonical import canonical
from tessera.logic.checker import Checker, nearest
from tessera.logic.repair import attempt, candidates
from tessera.models.operators import LinearOperator, Registry, export_onnx, neural_scan
from tessera.operators import datalog
from tessera.operators import provenance as prov
from tessera.plans import pareto
from tessera.plans.statements import Constraints
from tessera.session import Config, Session
from tessera.sources.ingest import from_arrow_stream, ingest_csv, ingest_frame, read_any, to_arrow_stream
from tessera.sources.shared import Store
from tessera.sources.versioned import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str, rules: tuple[str, ...] = (), tables: tuple[str, ...] = STAR, **config) -> Session:
    s = Session(spark, Config(**({"provenance": "none"} | config)))
    for t in tables:
        s.register_table(t, table(spark, sf_dir, t))
    for i, source in enumerate(rules):
        s.register_rule(f"rule_{i}", source)
    return s


def same_sql(name: str, text: str, spark_text: str | None = None) -> None:
    """A query that is the same statement in both engines (Spark may have its own spelling)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir, tables=(*STAR, "labels", "documents", "embeddings")).sql(spark_text or text).frame

    QUERIES[name], ORACLE_SQL[name] = run, text


# rules on results -----------------------------------------------------------------------------------------------------
_COLUMNS = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag"
BULK = "l_discount > 0.05 AND l_quantity > 25"


@query(f"SELECT {_COLUMNS} FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 25")
def guard_bare_result(spark, sf_dir):
    return session(spark, sf_dir, (BULK,)).sql(f"SELECT {_COLUMNS} FROM lineitem").frame


_TOP = f"SELECT {_COLUMNS} FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 500"


@query(f"SELECT * FROM ({_TOP}) WHERE l_discount > 0.05 AND l_quantity > 25")
def guard_after_limit(spark, sf_dir):
    return session(spark, sf_dir, (BULK,)).sql(_TOP).frame


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05) AS d FROM lineitem WHERE nullif(l_discount, 0.05) IS NULL OR nullif(l_discount, 0.05) > 0.07")
def guard_null_pass(spark, sf_dir):
    return session(spark, sf_dir, ("d > 0.07",)).sql("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05D) AS d FROM lineitem").frame


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def guard_type_gate(spark, sf_dir):
    return session(spark, sf_dir, ("l_linenumber > 3",)).sql("SELECT l_orderkey, l_linenumber FROM lineitem").frame


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 3")
def guard_strict_mode(spark, sf_dir):
    return session(spark, sf_dir, ("l_linenumber > 3",), rule_mode="strict").sql("SELECT l_orderkey, l_linenumber FROM lineitem").frame


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def guard_string_eq(spark, sf_dir):
    return session(spark, sf_dir, ("l_returnflag = 'R'",)).sql("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem").frame


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def guard_string_order_pass(spark, sf_dir):
    return session(spark, sf_dir, ("l_returnflag > 'A'",)).sql("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem").frame


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.04) < 2.220446049250313e-16")
def guard_float_eq(spark, sf_dir):
    return session(spark, sf_dir, ("l_discount = 0.04",)).sql("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem").frame


@query(f"SELECT {_COLUMNS} FROM lineitem WHERE l_discount > 0.02 AND l_quantity <= 10 AND l_returnflag != 'N'")
def guard_multi_rule(spark, sf_dir):
    return session(spark, sf_dir, ("l_discount > 0.02", "r(X) :- lineitem(X), l_quantity <= 10, l_returnflag != 'N'.")).sql(f"SELECT {_COLUMNS} FROM lineitem").frame


@query("SELECT o_orderkey, o_totalprice FROM orders")
def guard_skip_irrelevant(spark, sf_dir):
    return session(spark, sf_dir, ("stock_level > 5",)).sql("SELECT o_orderkey, o_totalprice FROM orders").frame


@query("SELECT l_returnflag, avg_discount FROM (SELECT l_returnflag, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1) WHERE avg_discount > 0.05")
def guard_alias_captured(spark, sf_dir):
    return session(spark, sf_dir, ("avg_discount > 0.05",)).sql("SELECT l_returnflag, round(avg(l_discount), 6) AS avg_discount FROM lineitem GROUP BY 1").frame


@query("SELECT count(*) AS c FROM lineitem")
def bare_guard_no_agg_effect(spark, sf_dir):
    return session(spark, sf_dir, (BULK,)).sql("SELECT count(*) AS c FROM lineitem").frame


# rules on scans -------------------------------------------------------------------------------------------------------
BULK_SCAN = "bulk(X) :- lineitem(X), X.l_discount > 0.05, X.l_quantity > 25."


@query("SELECT count(*) AS c FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 25")
def scan_guard_count(spark, sf_dir):
    return session(spark, sf_dir, (BULK_SCAN,)).sql("SELECT count(*) AS c FROM lineitem").frame


@query(
    "SELECT o_orderpriority, count(*) AS c, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    " WHERE l_discount > 0.05 AND l_quantity > 25 GROUP BY 1"
)
def scan_guard_join(spark, sf_dir):
    text = "SELECT o_orderpriority, count(*) AS c, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
    return session(spark, sf_dir, (BULK_SCAN,)).sql(text).frame


@query("SELECT l_returnflag, count(1) AS cnt, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem WHERE l_discount > 0.05 AND l_quantity > 25 GROUP BY l_returnflag")
def flagship_guarded_group(spark, sf_dir):
    return session(spark, sf_dir, (BULK_SCAN,)).sql("SELECT l_returnflag, count(1) AS cnt, round(avg(l_extendedprice), 2) AS avg_price FROM lineitem GROUP BY l_returnflag").frame


@query("SELECT count(*) AS c FROM orders")
def scan_guard_scope_relation(spark, sf_dir):
    return session(spark, sf_dir, ("r(X) :- lineitem(X), X.o_totalprice > 100000.",), scan_scope="relation").sql("SELECT count(*) AS c FROM orders").frame


# plain SQL ------------------------------------------------------------------------------------------------------------
_AGG = "count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_discount) AS hi"
same_sql("sql_groupby", f"SELECT l_returnflag, l_linestatus, {_AGG} FROM lineitem GROUP BY l_returnflag, l_linestatus")
same_sql("sql_having", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 30")
same_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
         "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS bigint) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same_sql("sql_grouping_sets", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
same_sql("sql_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem GROUP BY l_returnflag")
same_sql("sql_filter_agg", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, round(sum(l_tax) FILTER (WHERE l_quantity > 10), 4) AS t FROM lineitem GROUP BY l_returnflag")
same_sql("sql_stat_agg", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_tax), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS rs, median(l_quantity) AS md FROM lineitem GROUP BY 1")
same_sql("sql_bool_bit_agg", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS b, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY 1")
same_sql("sql_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY 1", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS s FROM nation GROUP BY 1")
same_sql("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same_sql("sql_join_inner", "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
same_sql("sql_join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
same_sql("sql_join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000")
same_sql("sql_join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 1000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) c ON s_suppkey = c_custkey")
same_sql("sql_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
same_sql("sql_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey")
same_sql("sql_join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
same_sql("sql_join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same_sql("sql_join_using", "SELECT o_orderkey, count(*) AS n FROM orders JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem) USING (o_orderkey) GROUP BY 1")
same_sql("sql_exists_in", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
same_sql("sql_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders)")
same_sql("sql_correlated", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
same_sql("sql_lateral", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")
same_sql("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY s DESC, o_custkey) AS k FROM big) SELECT o_custkey, round(s, 2) AS s, k FROM r WHERE k <= 50",
         "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_custkey, round(s, 2) AS s, cast(row_number() OVER (ORDER BY s DESC, o_custkey) AS bigint) AS k FROM (SELECT * FROM big ORDER BY s DESC, o_custkey LIMIT 50)")
same_sql("sql_window_rank", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
         "SELECT o_orderkey, cast(rank() OVER w AS bigint) AS r, cast(dense_rank() OVER w AS bigint) AS d, cast(row_number() OVER w AS bigint) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
same_sql("sql_window_lag", "SELECT event_id, lag(value) OVER w AS p, lead(value, 2) OVER w AS q, first_value(value) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
same_sql("sql_window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events")
same_sql("sql_window_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS q FROM orders",
         "SELECT o_orderkey, cast(ntile(4) OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS bigint) AS q FROM orders")
same_sql("sql_window_dist", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
same_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
same_sql("sql_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
same_sql("sql_union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
same_sql("sql_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
same_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same_sql("sql_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
same_sql("sql_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey % 5 FROM nation WHERE n_name > 'G'")
same_sql("sql_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
same_sql("sql_case_null", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'O'), '?') AS st, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l FROM orders")
same_sql("sql_string", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS lo, length(p_type) AS n, substr(p_name, 2, 3) AS s, replace(p_type, ' ', '_') AS r, concat_ws('-', p_brand, p_type) AS c, lpad(cast(p_size AS varchar), 4, '0') AS lp, reverse(p_brand) AS rv, split_part(p_type, ' ', 1) AS sp, strpos(p_type, 'S') AS ix, trim(p_name) AS t, translate(p_brand, 'abc', 'xyz') AS tr FROM part",
         "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS lo, cast(length(p_type) AS bigint) AS n, substr(p_name, 2, 3) AS s, replace(p_type, ' ', '_') AS r, concat_ws('-', p_brand, p_type) AS c, lpad(cast(p_size AS string), 4, '0') AS lp, reverse(p_brand) AS rv, split_part(p_type, ' ', 1) AS sp, cast(instr(p_type, 'S') AS bigint) AS ix, trim(p_name) AS t, translate(p_brand, 'abc', 'xyz') AS tr FROM part")
same_sql("sql_regex", "SELECT p_partkey, regexp_matches(p_type, '^[A-M]') AS m, regexp_replace(p_name, '[aeiou]', '', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%a%' AS lk, p_name ILIKE '%A%' AS il FROM part",
         "SELECT p_partkey, p_type RLIKE '^[A-M]' AS m, regexp_replace(p_name, '[aeiou]', '') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS d, p_name LIKE '%a%' AS lk, p_name ILIKE '%A%' AS il FROM part")
same_sql("sql_date", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, date_trunc('month', o_orderdate) AS t, o_orderdate + INTERVAL 3 DAY AS p, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS n FROM orders",
         "SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, cast(day(o_orderdate) AS bigint) AS d, cast(quarter(o_orderdate) AS bigint) AS q, cast(date_trunc('month', o_orderdate) AS timestamp_ntz) AS t, o_orderdate + INTERVAL 3 DAY AS p, cast(datediff(o_orderdate, DATE'1992-01-01') AS bigint) AS n FROM orders")
same_sql("sql_date_bin", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, count(*) AS n FROM events GROUP BY 1",
         "SELECT cast(timestamp_seconds(unix_timestamp(cast(ts AS timestamp)) div 900 * 900) AS timestamp_ntz) AS b, count(*) AS n FROM events GROUP BY 1")
same_sql("sql_math", "SELECT l_orderkey, l_linenumber, abs(-l_tax) AS a, ceil(l_quantity / 3) AS c, floor(l_quantity / 3) AS f, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_extendedprice), 6) AS n, round(power(l_quantity, 1.5), 4) AS p, l_orderkey % 7 AS m, sign(l_discount - 0.05) AS g, round(log10(l_extendedprice), 6) AS lg, round(cbrt(l_quantity), 6) AS cb, l_orderkey // 4 AS dv FROM lineitem",
         "SELECT l_orderkey, l_linenumber, abs(-l_tax) AS a, cast(ceil(l_quantity / 3) AS double) AS c, cast(floor(l_quantity / 3) AS double) AS f, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_extendedprice), 6) AS n, round(power(l_quantity, 1.5), 4) AS p, l_orderkey % 7 AS m, cast(sign(l_discount - 0.05D) AS tinyint) AS g, round(log10(l_extendedprice), 6) AS lg, round(cbrt(l_quantity), 6) AS cb, l_orderkey div 4 AS dv FROM lineitem")
same_sql("sql_array", "SELECT vec_id, len(embedding) AS n, round(embedding[1], 5) AS e1, round(list_max(embedding), 5) AS mx, round(list_min(embedding), 5) AS mn, list_contains([1, 2, 3], label) AS has FROM embeddings",
         "SELECT vec_id, cast(size(embedding) AS bigint) AS n, round(embedding[0], 5) AS e1, round(array_max(embedding), 5) AS mx, round(array_min(embedding), 5) AS mn, array_contains(array(1, 2, 3), label) AS has FROM embeddings")
same_sql("sql_array_agg_unnest", "SELECT u.k AS k, count(*) AS n FROM (SELECT unnest(ks) AS k FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS ks FROM orders GROUP BY 1)) u GROUP BY 1",
         "SELECT k, count(*) AS n FROM (SELECT explode(ks) AS k FROM (SELECT o_custkey, collect_set(o_orderpriority) AS ks FROM orders GROUP BY 1)) GROUP BY 1")
same_sql("sql_hash", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer")
same_sql("sql_values_cast", "SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS b, cast(o_orderkey AS varchar) AS v FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000 OR o_orderstatus IN ('P')",
         "SELECT o_orderkey, cast(floor(o_totalprice) AS bigint) AS b, cast(o_orderkey AS string) AS v FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000 OR o_orderstatus IN ('P')")
same_sql("sql_pivot", "SELECT l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
         "SELECT l_linenumber, coalesce(A, 0) AS a, coalesce(N, 0) AS n, coalesce(R, 0) AS r FROM (SELECT l_linenumber, l_returnflag FROM lineitem) PIVOT (count(*) FOR l_returnflag IN ('A', 'N', 'R'))")


@query("SELECT count(*) AS rows, true AS near FROM (SELECT DISTINCT l_partkey FROM lineitem) HAVING count(*) > 0")
def sql_approx(spark, sf_dir):
    """Approximate distinct count and quantile, judged against the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    row = lines.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("n"), F.percentile_approx("l_quantity", 0.5).alias("q"), F.median("l_quantity").alias("m"))
    return row.select(F.col("n").alias("rows"), ((F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")) & (F.abs(F.col("q") - F.col("m")) <= 1)).alias("near"))


# rule evaluation ------------------------------------------------------------------------------------------------------
@query("SELECT c_nationkey AS k, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def datalog_natural_join(spark, sf_dir):
    s = session(spark, sf_dir, tables=())
    s.add_facts("cust", table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey"))
    s.add_facts("nat", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name"))
    return s.evaluate("both(X) :- cust(X), nat(X).")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000")
def datalog_var_join(spark, sf_dir):
    rule = "rich(O) :- orders(O), customer(C), O.o_custkey = C.c_custkey, O.o_totalprice > 200000."
    return session(spark, sf_dir).evaluate(rule).select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > p_retailprice")
def datalog_range_join(spark, sf_dir):
    rule = "dear(L) :- lineitem(L), part(P), L.l_partkey = P.p_partkey, L.l_extendedprice > P.p_retailprice."
    return session(spark, sf_dir).evaluate(rule).select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def datalog_chain_join(spark, sf_dir):
    rule = "where(S) :- supplier(S), nation(N), region(R), S.s_nationkey = N.n_nationkey, N.n_regionkey = R.r_regionkey."
    return session(spark, sf_dir).evaluate(rule).select("s_suppkey", "n_name", "r_name")


_EDGES = "SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation"


@query(f"WITH RECURSIVE e AS ({_EDGES}), p(x, y) AS (SELECT a, b FROM e UNION SELECT p.x, e.b FROM p JOIN e ON p.y = e.a) SELECT x, y FROM p")
def datalog_transitive_closure(spark, sf_dir):
    s = session(spark, sf_dir, tables=("nation",))
    s.add_facts("edges", spark.sql(_EDGES))
    s.register_rule("base", "path(A, B) :- edges(A, B).")
    found = s.evaluate("path(A, C) :- path(A, B), edges(B, C).")
    return found.toDF("x", "y")


@query("SELECT DISTINCT n_nationkey AS N, n_regionkey AS R FROM nation WHERE n_regionkey = 2")
def datalog_positional(spark, sf_dir):
    s = session(spark, sf_dir, tables=())
    s.add_facts("nat", table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    return s.evaluate("r(N, R) :- nat(N, R), R = 2.")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def datalog_single_relation(spark, sf_dir):
    return session(spark, sf_dir).evaluate("big(X) :- orders(X), X.o_totalprice > 250000.").select("o_orderkey", "o_totalprice")


@query("SELECT 'a' AS name, count(*) AS n FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'b', count(*) FROM nation WHERE n_regionkey = 1")
def datalog_evaluate_all(spark, sf_dir):
    s = session(spark, sf_dir)
    s.register_rule("a", "a(X) :- orders(X), X.o_totalprice > 250000.")
    s.register_rule("b", "b(X) :- nation(X), X.n_regionkey = 1.")
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, f in s.evaluate_all().items()]
    return parts[0].union(parts[1])


# models ---------------------------------------------------------------------------------------------------------------
MODEL = LinearOperator("risk", [1e-5, 3.0, 0.02], -1.5, features=["l_extendedprice", "l_discount", "l_quantity"])
_SCORE = "1 / (1 + exp(-(-1.5 + 1e-5 * CAST(l_extendedprice AS FLOAT)::DOUBLE + 3 * CAST(l_discount AS FLOAT)::DOUBLE + 0.02 * CAST(l_quantity AS FLOAT)::DOUBLE)))"


def _risk(spark, sf_dir) -> Session:
    s = session(spark, sf_dir)
    s.register_model(MODEL, "m1")
    return s


@query(f"SELECT l_orderkey, l_linenumber, round({_SCORE}, 6) AS p FROM lineitem")
def predict_value(spark, sf_dir):
    out = _risk(spark, sf_dir).sql("PREDICT VALUE OF late FROM lineitem WITH (model = 'risk')").frame
    return out.select("l_orderkey", "l_linenumber", F.round("prediction_late", 6).alias("p"))


@query(f"SELECT l_orderkey, l_linenumber, CAST({_SCORE} >= 0.5 AS BIGINT) AS prediction_late FROM lineitem")
def predict_class(spark, sf_dir):
    return _risk(spark, sf_dir).sql("PREDICT CLASS OF late FROM lineitem WITH (model = 'risk')").frame.select("l_orderkey", "l_linenumber", "prediction_late")


@query(f"SELECT l_returnflag, round(avg({_SCORE}), 6) AS p FROM lineitem GROUP BY 1")
def model_udf_inline(spark, sf_dir):
    return _risk(spark, sf_dir).sql("SELECT l_returnflag, round(avg(risk(l_extendedprice, l_discount, l_quantity)), 6) AS p FROM lineitem GROUP BY 1").frame


@query(f"SELECT round({_SCORE}, 6) AS score FROM lineitem")
def replace_schema_scan(spark, sf_dir):
    return neural_scan(table(spark, sf_dir, "lineitem"), MODEL).select(F.round("score", 6).alias("score"))


@query(f"SELECT l_orderkey, l_linenumber, round({_SCORE}, 6) AS score FROM lineitem WHERE l_quantity > 45")
def constrained_query(spark, sf_dir):
    s = _risk(spark, sf_dir)
    text = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity FROM lineitem WHERE l_quantity > 45 WITH (max_latency_ms = 1000000, min_accuracy = 0.9)"
    return s.sql(text).frame.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


_PLANS = "(SELECT s_name AS plan_id, s_acctbal + 1000 AS latency, (s_suppkey % 89) / 100.0::DOUBLE AS accuracy, CAST(s_nationkey AS DOUBLE) AS cost FROM supplier)"
_BEATS = "q.latency <= p.latency AND q.accuracy >= p.accuracy AND q.cost <= p.cost AND (q.latency < p.latency OR q.accuracy > p.accuracy OR q.cost < p.cost)"
_FRONTIER = f"SELECT p.* FROM {_PLANS} p WHERE NOT EXISTS (SELECT 1 FROM {_PLANS} q WHERE {_BEATS})"


def _plans(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_name AS plan_id", "s_acctbal + 1000 AS latency", "(s_suppkey % 89) / 100D AS accuracy", "double(s_nationkey) AS cost")


@query(_FRONTIER)
def pareto_frontier(spark, sf_dir):
    return pareto.frontier_frame(_plans(spark, sf_dir))


@query(f"SELECT * FROM ({_FRONTIER}) WHERE accuracy >= 0.6 AND cost <= 20 ORDER BY latency, accuracy DESC, cost, plan_id LIMIT 1")
def pareto_constrained(spark, sf_dir):
    return pareto.choose_frame(_plans(spark, sf_dir), Constraints(min_accuracy=0.6, max_cost=20))


_SITES = "(SELECT s_name AS plan_id, s_acctbal + 1000 + s_nationkey * 10 AS latency, (s_suppkey % 89) / 100.0::DOUBLE AS accuracy, CAST(s_nationkey AS DOUBLE) AS cost FROM supplier)"


@query(f"SELECT plan_id, latency FROM (SELECT p.* FROM {_SITES} p WHERE NOT EXISTS (SELECT 1 FROM {_SITES} q WHERE {_BEATS})) WHERE latency <= 6000 AND accuracy >= 0.3 ORDER BY accuracy DESC, latency, plan_id LIMIT 1")
def pareto_distributed(spark, sf_dir):
    sites = table(spark, sf_dir, "supplier").selectExpr("s_name AS plan_id", "s_acctbal + 1000 AS compute_ms", "s_nationkey * 10D AS network_ms", "(s_suppkey % 89) / 100D AS accuracy", "double(s_nationkey) AS cost")
    return pareto.choose_distributed(sites, Constraints(max_latency_ms=6000, min_accuracy=0.3)).select("plan_id", "latency")


@query("SELECT s_name AS name, (s_suppkey % 89) / 100.0::DOUBLE AS accuracy FROM supplier WHERE (s_suppkey % 89) / 100.0 >= 0.4 AND s_name <> 'Supplier#000000088' ORDER BY 2 DESC, 1 LIMIT 1")
def progressive_rewrite(spark, sf_dir):
    others = table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "(s_suppkey % 89) / 100D AS accuracy")
    return pareto.progressive_rewrite("Supplier#000000088", 0.25, 0.4, others)


@query("SELECT 'model_' || n_regionkey AS function_id, arg_max(n_nationkey || '.' || n_regionkey || '.0', n_nationkey) AS version FROM nation GROUP BY n_regionkey")
def latest_model_version(spark, sf_dir):
    """The registry's latest version of each function, 10.0.0 being later than 9.0.0; versions are those of nations' numbers."""
    registry = Registry()
    for r in table(spark, sf_dir, "nation").orderBy(F.desc("n_name")).collect():  # 25 rows
        registry.register(LinearOperator(f"model_{r['n_regionkey']}", [1.0], version=f"{r['n_nationkey']}.{r['n_regionkey']}.0"), r["n_name"])
    names = sorted({f for f, _ in registry.operators})
    return spark.createDataFrame([(f, registry.latest(f).version) for f in names], "function_id string, version string")


_DEEP = LinearOperator("deep", [0.25, -0.125], 0.5, features=["l_linenumber", "l_quantity"])


def _deep(spark, sf_dir) -> Session:
    """A model file in a session: the operator exported, written and loaded."""
    s = session(spark, sf_dir)
    with tempfile.NamedTemporaryFile(suffix=".onnx") as f:
        f.write(export_onnx(_DEEP))
        f.flush()
        s.load_model("deep", f.name, features=_DEEP.features)
    return s


_DEEP_SQL = "round(1 / (1 + exp(-(0.5 + 0.25 * l_linenumber - 0.125 * l_quantity))), 3)"


@query(f"SELECT l_orderkey, l_linenumber, {_DEEP_SQL} AS p FROM lineitem")
def onnx_predict(spark, sf_dir):
    out = _deep(spark, sf_dir).sql("PREDICT VALUE OF x FROM lineitem WITH (model = 'deep')").frame
    return out.select("l_orderkey", "l_linenumber", F.round("prediction_x", 3).alias("p"))


@query(f"SELECT l_returnflag, count(*) FILTER (WHERE {_DEEP_SQL} > 0.25) AS n FROM lineitem GROUP BY 1")
def onnx_function(spark, sf_dir):
    return _deep(spark, sf_dir).sql("SELECT l_returnflag, count_if(round(deep(l_linenumber, l_quantity), 3) > 0.25) AS n FROM lineitem GROUP BY 1").frame


@query("SELECT * FROM (VALUES ('m1', 'risk', '1.0.0', 1.0::DOUBLE, 0.95::DOUBLE)) t(model_id, name, version, avg_latency_ms, accuracy)")
def catalog_models(spark, sf_dir):
    return _risk(spark, sf_dir).sql("SELECT model_id, name, version, avg_latency_ms, accuracy FROM __ai_models").frame


# provenance -----------------------------------------------------------------------------------------------------------
_NATION = "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 25"


def _hexed(spark, sf_dir, mode):
    return session(spark, sf_dir, provenance=mode).sql(_NATION).frame.select("n_nationkey", F.hex("provenance").alias("h"))


@query("SELECT n_nationkey, '01' AS h FROM nation")
def prov_boolean(spark, sf_dir):
    return _hexed(spark, sf_dir, "boolean")


@query("SELECT n_nationkey, '000000000000F03F' AS h FROM nation")
def prov_probability(spark, sf_dir):
    return _hexed(spark, sf_dir, "probability")


_ROW = "row_number() OVER (ORDER BY n_nationkey) - 1"


@query(
    f"SELECT n_nationkey, '0100000000000000' || upper(printf('%02x', 25 + length(CAST({_ROW} AS VARCHAR)))) || '00000000000000' || hex('query_pipeline:sql:[row_' || CAST({_ROW} AS VARCHAR) || ']') || '0100000000000000' AS h FROM nation"
)
def prov_poly_bytes_hex(spark, sf_dir):
    return _hexed(spark, sf_dir, "polynomial")


@query("SELECT n_regionkey, string_agg('n' || n_nationkey, ' ⊕ ' ORDER BY 'n' || n_nationkey) AS p FROM nation GROUP BY 1")
def prov_polynomial_text(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_regionkey", prov.monomial(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("poly"))
    return prov.sum_polynomials(rows, ["n_regionkey"]).select("n_regionkey", prov.polynomial_text(F.col("poly")).alias("p"))


@query("SELECT l_orderkey, bool_or(l_discount > 0.09) AS b, round(1 - product(1 - l_discount), 9) AS p FROM lineitem GROUP BY 1")
def prov_or_agg(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(prov.any_of(F.col("l_discount") > 0.09).alias("b"), F.round(prov.noisy_or(F.col("l_discount")), 9).alias("p"))


@query("SELECT s_suppkey, round(0.5 * (n_nationkey / 25.0), 9) AS p, (s_suppkey % 2 = 0) AND (n_nationkey > 5) AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def prov_and_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit(0.5).alias("p1"), (F.col("s_suppkey") % 2 == 0).alias("b1"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 25.0).alias("p2"), (F.col("n_nationkey") > 5).alias("b2"))
    out = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.select("s_suppkey", F.round(prov.product(F.col("p1"), F.col("p2")), 9).alias("p"), prov.both(F.col("b1"), F.col("b2")).alias("b"))


@query("SELECT s_suppkey, least('n' || n_nationkey, 's' || s_suppkey) || '⊗' || greatest('n' || n_nationkey, 's' || s_suppkey) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def prov_poly_join(spark, sf_dir):
    name = lambda c, k: prov.monomial(F.concat(F.lit(k), F.col(c).cast("string")))
    s = table(spark, sf_dir, "supplier").withColumn("a", name("s_suppkey", "s"))
    n = table(spark, sf_dir, "nation").withColumn("b", name("n_nationkey", "n"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", prov.polynomial_text(prov.times(F.col("a"), F.col("b"))).alias("p"))


@query("SELECT l_returnflag, l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1, 2")
def prov_poly_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", prov.monomial(F.col("l_linenumber").cast("string")).alias("poly"))
    return prov.sum_polynomials(rows, ["l_returnflag"]).select("l_returnflag", F.explode("poly").alias("k", "c")).withColumn("k", F.col("k").cast("int"))


@query("SELECT * FROM (VALUES (500, 'polynomial'), (5000, 'probability'), (50000, 'boolean')) t(n, mode)")
def adaptive_mode(spark, sf_dir):
    return spark.createDataFrame([(n, prov.adaptive_mode(n)) for n in (500, 5000, 50000)], "n int, mode string")


# monitoring -----------------------------------------------------------------------------------------------------------
def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("value") / 500).alias("confidence"))


_LOW = "avg(CASE WHEN value / 500 < 0.5 THEN 1.0 ELSE 0.0 END)"


@query(f"SELECT count(*) AS n, round({_LOW}, 6) AS low_rate, {_LOW} > 0.8 AS is_low_confidence, false AS is_uniform, false AS is_empty FROM events")
def monitor_low_conf(spark, sf_dir):
    return monitor.report(_scored(spark, sf_dir), "confidence").withColumn("low_rate", F.round("low_rate", 6))


@query("SELECT count(*) AS n, true AS is_uniform FROM nation")
def monitor_uniform(spark, sf_dir):
    return monitor.report(table(spark, sf_dir, "nation").select(F.lit(0.7).alias("confidence")), "confidence").select("n", "is_uniform")


@query("SELECT CAST(0 AS BIGINT) AS n, true AS is_empty")
def monitor_empty(spark, sf_dir):
    return monitor.report(_scored(spark, sf_dir).filter("confidence < 0"), "confidence").select("n", "is_empty")


@query("SELECT min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events")
def explain_stats(spark, sf_dir):
    return explainer.score_stats(table(spark, sf_dir, "events"), "value").select("min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0.05 AND l_returnflag <> 'N'")
def drop_null_rows(spark, sf_dir):
    holes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "nullif(l_discount, 0.05D) AS d", "nullif(l_returnflag, 'N') AS f")
    return triage.drop_null_rows(holes).select("l_orderkey", "l_linenumber")


@query("SELECT CAST(user_id AS VARCHAR) AS tuple_id, count(*) AS hops, round(sum(value), 4) AS total_ms, string_agg(event_id || ':' || event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY 1")
def lineage_trace(spark, sf_dir):
    segments = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("tuple_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("node"), F.lit("op").alias("operation"), F.col("value").alias("duration_ms"))
    path = F.array_join(F.transform("path", lambda x: F.concat_ws(":", x["seq"], x["node"])), ">")
    return lineage.traces(segments).select("tuple_id", "hops", F.round("total_ms", 4).alias("total_ms"), path.alias("path"))


# functions ------------------------------------------------------------------------------------------------------------
def _triples(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    side = lambda k, tag: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(tag))
    return e.select("vec_id", F.col("embedding").alias("h")).join(side(1, "r"), "vec_id").join(side(2, "t"), "vec_id").join(side(3, "w"), "vec_id")


_T = "FROM embeddings h JOIN embeddings r ON r.vec_id = h.vec_id + 1 JOIN embeddings t ON t.vec_id = h.vec_id + 2 JOIN embeddings w ON w.vec_id = h.vec_id + 3"
_N = "generate_series(1, len(h.embedding))"


def _sum_sql(term: str) -> str:
    return f"list_sum(list_transform({_N}, lambda i: {term}))"


_e = lambda x: f"{x}.embedding[i]::DOUBLE"


@query(f"SELECT h.vec_id AS vec_id, round(-sqrt({_sum_sql(f'pow({_e("h")} + {_e("r")} - {_e("t")}, 2)')}), 4) AS s {_T}")
def transe_score(spark, sf_dir):
    return _triples(spark, sf_dir).select("vec_id", F.round(vectors.transe("h", "r", "t"), 4).alias("s"))


@query(
    f"WITH d AS (SELECT h.vec_id AS vec_id, h.embedding AS he, r.embedding AS re, t.embedding AS te, w.embedding AS we, {_sum_sql(f'{_e("w")} * {_e("h")}')} AS wh, {_sum_sql(f'{_e("w")} * {_e("t")}')} AS wt {_T})"
    " SELECT vec_id, round(-sqrt(list_sum(list_transform(generate_series(1, len(he)), lambda i: pow((he[i]::DOUBLE - wh * we[i]) + re[i]::DOUBLE - (te[i]::DOUBLE - wt * we[i]), 2)))), 4) AS s FROM d"
)
def transh_score(spark, sf_dir):
    return _triples(spark, sf_dir).select("vec_id", F.round(vectors.transh("h", "r", "t", "w"), 4).alias("s"))


@query(
    "SELECT e.vec_id AS vec_id, round(sqrt(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))), 4) AS distance"
    " FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY sqrt(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: pow(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE, 2)))), e.vec_id LIMIT 20"
)
def l2_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id = 7").select("embedding").first()["embedding"]
    return vectors.nearest(e, asked, 20).select("vec_id", F.round("distance", 4).alias("distance"))


def _boxes(spark, sf_dir) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    box = lambda x, w: F.struct(x.alias("min_x"), x.alias("min_y"), x.alias("min_z"), (x + w).alias("max_x"), (x + w).alias("max_y"), (x + w).alias("max_z"))
    return table(spark, sf_dir, "part").select("p_partkey", box(F.lit(0.0), size).alias("a"), box(price / 100, F.lit(20.0)).alias("b"))


_SIDE = "greatest(least(p_size::DOUBLE, p_retailprice / 100 + 20) - greatest(0.0, p_retailprice / 100), 0.0)"


@query(f"SELECT p_partkey, CASE WHEN {_SIDE} = 0 THEN 0.0 ELSE round(pow({_SIDE}, 3) / (pow(p_size, 3) + 8000 - pow({_SIDE}, 3)), 6) END AS iou FROM part")
def bbox_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("p_partkey", F.round(spatial.box_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("SELECT p_partkey, round(pow(p_size::DOUBLE, 3), 4) AS v, p_size / 2.0::DOUBLE AS cx FROM part")
def bbox_volume(spark, sf_dir):
    return _boxes(spark, sf_dir).select("p_partkey", F.round(spatial.box_volume(F.col("a")), 4).alias("v"), spatial.box_center(F.col("a"))["x"].alias("cx"))


@query("SELECT p_partkey, round(sqrt(pow(p_size - 1, 2) + pow(p_retailprice - 2, 2) + 4), 6) AS d FROM part")
def point_distance(spark, sf_dir):
    a = F.struct(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(1.0).alias("z"))
    b = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(spatial.point_distance(a, b), 6).alias("d"))


@query("SELECT l_orderkey, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y FROM lineitem GROUP BY 1")
def centroid(spark, sf_dir):
    p = F.struct(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.lit(0.0).alias("z"))
    clouds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(p).alias("c"))
    return clouds.select("l_orderkey", spatial.centroid(F.col("c")).alias("m")).select("l_orderkey", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


def _sounds(spark, sf_dir) -> DataFrame:
    e = F.struct(F.col("event_type").alias("label"), F.hour("ts").cast("double").alias("start"), (F.hour("ts") + 1).cast("double").alias("end"), (F.col("value") / 500).alias("confidence"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(e).alias("e"))


@query("SELECT user_id, count(*) FILTER (WHERE hour(ts) >= 6 AND hour(ts) < 12) AS n FROM events GROUP BY 1")
def audio_window(spark, sf_dir):
    return _sounds(spark, sf_dir).select("user_id", F.size(spatial.events_in_window(F.col("e"), 6, 12)).cast("long").alias("n"))


@query("SELECT user_id, round(avg(value / 500), 6) AS c FROM events GROUP BY 1")
def audio_mean_conf(spark, sf_dir):
    return _sounds(spark, sf_dir).select("user_id", F.round(spatial.mean_confidence(F.col("e")), 6).alias("c"))


def _mel(spark, sf_dir) -> DataFrame:
    m = F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("values"), F.lit(8).alias("n_mels"), F.lit(8).alias("n_frames"), F.lit(16000).alias("sample_rate"), F.lit(160).alias("hop_length"))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("mel"))


@query("SELECT vec_id, round(embedding[2 * 8 + 3 + 1]::DOUBLE, 6) AS v, CAST(NULL AS DOUBLE) AS outside FROM embeddings")
def mel_lookup(spark, sf_dir):
    return _mel(spark, sf_dir).select("vec_id", F.round(spatial.mel_value(F.col("mel"), 2, 3), 6).alias("v"), spatial.mel_value(F.col("mel"), 9, 0).alias("outside"))


@query("SELECT vec_id, 0.08::DOUBLE AS s FROM embeddings")
def mel_duration(spark, sf_dir):
    return _mel(spark, sf_dir).select("vec_id", spatial.mel_duration(F.col("mel")).alias("s"))


@query("SELECT 3.75::DOUBLE AS ms, round(0.95 * least(1.0, 0.97 * sqrt(1.0)), 6)::DOUBLE AS acc, true AS ok, round(3.2 * 0.97, 6)::DOUBLE AS score")
def distill_estimate(spark, sf_dir):
    t = spark.createDataFrame([(12.0, 0.95, 10, 4.0)], "ms double, acc double, epochs int, temp double")
    ms, acc = estimates.student_latency(F.col("ms")), estimates.student_accuracy(F.col("acc"), F.col("epochs"), F.col("temp"))
    return t.select(ms.alias("ms"), F.round(acc, 6).alias("acc"), estimates.accepted(ms, acc, F.lit(5.0), F.lit(0.85)).alias("ok"), F.round(estimates.pareto_score(F.col("ms"), ms, acc, F.col("acc")), 6).alias("score"))


@query("SELECT round(least(0.15, ln(6) / 10 * 0.1), 7)::DOUBLE AS gain, CAST(5 AS INTEGER) AS frozen")
def finetune_estimate(spark, sf_dir):
    t = spark.createDataFrame([(5, 0.001, 9, 6)], "epochs int, lr double, asked int, layers int")
    return t.select(F.round(estimates.tuning_gain(F.col("epochs"), F.col("lr")), 7).alias("gain"), estimates.frozen_layers(F.col("asked"), F.col("layers")).alias("frozen"))


@query("SELECT event_id, round(exp(value / 500 / 4) / (exp(value / 500 / 4) + exp((1 - value / 500) / 4)), 6) AS p FROM events")
def softmax_temperature(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(estimates.softmax_pair(F.col("value") / 500, F.lit(4.0)), 6).alias("p"))


# storage --------------------------------------------------------------------------------------------------------------
def _versions(spark, sf_dir) -> VersionedTable:
    t = VersionedTable(spark, f"{Store(spark, 'nation-versions').path}/t")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    t.create(nation.filter("n_nationkey < 20"))
    t.insert(nation.filter("n_nationkey >= 20"))
    t.delete("n_regionkey = 2")
    return t


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2")
def versioned_insert_delete(spark, sf_dir):
    return _versions(spark, sf_dir).read()


@query("SELECT 1 AS version, count(*) FILTER (WHERE n_nationkey < 20) AS n FROM nation UNION ALL SELECT 2, count(*) FROM nation UNION ALL SELECT 3, count(*) FILTER (WHERE n_regionkey <> 2) FROM nation")
def time_travel_count(spark, sf_dir):
    t = _versions(spark, sf_dir)
    parts = [t.read(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n") for v in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey NOT IN (1, 2)")
def versioned_update(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.update({"n_name": "upper(n_name)"}, "n_regionkey = 1")
    return t.read()


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'new' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 OR n_nationkey < 3")
def versioned_merge(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.merge(table(spark, sf_dir, "nation").filter("n_nationkey < 3").selectExpr("n_nationkey", "'new' AS n_name", "n_regionkey"), ["n_nationkey"])
    return t.read()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def csv_ingest(spark, sf_dir):
    path = Store(spark, "nation-csv").path
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.csv(f"{path}/in", header=True)
    return ingest_csv(spark, f"{path}/in", f"{path}/out")


# control --------------------------------------------------------------------------------------------------------------
def _log(spark, sf_dir) -> DataFrame:
    """A log of policy changes: each nation is a change of its region's policy."""
    return table(spark, sf_dir, "nation").selectExpr("concat('region_', n_regionkey) AS policy_id", "bigint(n_nationkey + 1) AS version", "n_nationkey % 3 > 0 AS active", "'area' AS category", "n_name AS body")


_LATEST = "SELECT 'region_' || n_regionkey AS policy_id, CAST(max(n_nationkey) + 1 AS BIGINT) AS version, max(n_nationkey) % 3 > 0 AS active FROM nation GROUP BY n_regionkey"


@query(_LATEST)
def policy_latest(spark, sf_dir):
    return policy.latest(_log(spark, sf_dir)).select("policy_id", "version", "active")


@query("SELECT 'region_' || n_regionkey AS policy_id, CAST(n_nationkey + 1 AS BIGINT) AS version FROM nation WHERE n_nationkey + 1 > 9")
def policy_changesets_since(spark, sf_dir):
    return policy.since(_log(spark, sf_dir), 9).select("policy_id", "version")


@query(f"SELECT count(*) FILTER (WHERE active) AS active, count(*) AS total, max(version) AS version FROM ({_LATEST})")
def policy_active_count(spark, sf_dir):
    return policy.summary(_log(spark, sf_dir))


def _nodes(spark, sf_dir) -> DataFrame:
    """A cluster: nations as nodes of three roles."""
    role = F.element_at(F.array(F.lit("core"), F.lit("edge"), F.lit("hybrid")), F.col("n_nationkey") % 3 + 1)
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("node_id"), role.alias("role"), (n * 512).cast("long").alias("memory_mb"), (n % 4).alias("accelerators"), ((n * 7 % 11) / 10).alias("load"))


_NODES = "(SELECT n_name AS node_id, n_nationkey % 3 AS r, n_nationkey * 512 AS memory_mb, n_nationkey % 4 AS accelerators, (n_nationkey * 7 % 11) / 10 AS load FROM nation)"


@query(f"SELECT node_id FROM {_NODES} WHERE accelerators > 0 ORDER BY r = 0, load, node_id LIMIT 1")
def route_perception(spark, sf_dir):
    return placement.route(_nodes(spark, sf_dir), "perception").select("node_id")


@query(f"SELECT node_id FROM {_NODES} WHERE memory_mb >= 6000 AND r <> 1 ORDER BY load, node_id LIMIT 1")
def route_symbolic(spark, sf_dir):
    return placement.route(_nodes(spark, sf_dir), "symbolic", 6000).select("node_id")


@query(f"SELECT node_id FROM {_NODES} WHERE memory_mb >= 3000 AND (r = 2 OR (r = 0 AND accelerators > 0)) ORDER BY load, node_id LIMIT 1")
def route_mixed(spark, sf_dir):
    return placement.route(_nodes(spark, sf_dir), "mixed", 3000).select("node_id")


@query("SELECT l_suppkey AS txn_id, count(DISTINCT l_partkey) AS keys FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1) GROUP BY 1")
def txn_conflicts(spark, sf_dir):
    return transactions.conflicts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("txn_id"), F.col("l_partkey").alias("key")))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS commits, count(*) FILTER (WHERE o_orderstatus = 'P') AS aborts, round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 9) AS conflict_rate FROM orders")
def txn_metrics(spark, sf_dir):
    log = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS txn_id", "CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'P' THEN 'aborted' ELSE 'active' END AS state", "o_totalprice AS duration_us")
    return transactions.log_metrics(log).select("commits", "aborts", F.round("conflict_rate", 9).alias("conflict_rate"))


@query("SELECT event_type AS tenant, count(*) AS queries, CAST(sum(user_id) AS BIGINT) AS rows, round(sum(value), 4) AS gpu_ms FROM events GROUP BY 1")
def metering(spark, sf_dir):
    return limits.metering(table(spark, sf_dir, "events").select(F.col("event_type").alias("tenant"), F.col("user_id").alias("rows"), F.col("value").alias("gpu_ms"))).withColumn("gpu_ms", F.round("gpu_ms", 4))


@query()
def rate_limit_fold(spark, sf_dir):
    """A token bucket for each user over the events in order of time: a sequential fold that SQL cannot express."""
    return limits.rate_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 2.0, 0.00005)


# rule tooling ---------------------------------------------------------------------------------------------------------
_CANONICAL = {
    "Cheap(l) :- LineItem(l), l.l_quantity >= 30, l.l_discount > 0.07.": "cheap(L) :- lineitem(L), L.l_discount > 0.07, L.l_quantity >= 30.",
    "at(S) :- supplier(S), nation(S), S.s_acctbal < 0.": "at(S) :- nation(S), supplier(S), S.s_acctbal < 0.",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CANONICAL.items()) + ") t(source, text)")
def rule_canonical(spark, sf_dir):
    return spark.createDataFrame([(k, canonical(k)) for k in _CANONICAL], "source string, text string")


@query("SELECT * FROM (VALUES ('r(X) :- orders(X), X.o_totalprice > 5.', ''), ('r(X) :- orderz(X), X.o_totalprice > 5.', 'VOCABULARY'), ('r(X) :- orders(X), X.o_totalprice > ''high''.', 'TYPE'), ('r(X) :- orders(X), Y.o_totalprice > 5.', 'SCOPE'), ('', 'SYNTAX')) t(source, findings)")
def rule_check(spark, sf_dir):
    checker = Checker({"orders": table(spark, sf_dir, "orders").schema})
    sources = ["r(X) :- orders(X), X.o_totalprice > 5.", "r(X) :- orderz(X), X.o_totalprice > 5.", "r(X) :- orders(X), X.o_totalprice > 'high'.", "r(X) :- orders(X), Y.o_totalprice > 5.", ""]
    return spark.createDataFrame([(s, ",".join(f.category for f in checker.check(s))) for s in sources], "source string, findings string")


@query("SELECT * FROM (VALUES (1, 'r(X) :- t(X), X.a >= 10.', 'operator'), (2, 'r(X) :- t(X), X.a > 1.', 'threshold'), (3, 'r(X) :- t(X), X.a > 100.', 'threshold')) t(k, source, kind)")
def rule_repair(spark, sf_dir):
    return spark.createDataFrame([(i, c.source, c.kind) for i, c in enumerate(candidates("r(X) :- t(X), X.a > 10."), 1)], "k int, source string, kind string")


@query("SELECT n_name AS name, levenshtein(n_name, 'NATION_1') AS d FROM nation ORDER BY 2, 1 LIMIT 5")
def levenshtein_suggest(spark, sf_dir):
    d = F.levenshtein(F.col("n_name"), F.lit("NATION_1")).cast("long")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), d.alias("d")).orderBy("d", "name").limit(5)


@query("SELECT n_name AS name, 'NATION_' || (n_nationkey // 10) AS found FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 10 = 9")
def nearest_name(spark, sf_dir):
    """Names with a digit too many: the nearest of those known."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").filter("n_nationkey >= 10 AND n_nationkey % 10 = 9").collect()]
    return spark.createDataFrame([(n, nearest(n, ["NATION_1", "NATION_2", "NATION_3"])) for n in names], "name string, found string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def repair_attempt(spark, sf_dir):
    """A rule that finds nothing, and the rows of the first change of it that does: a tenth of its threshold."""
    s = session(spark, sf_dir)
    found = attempt("big(O) :- orders(O), O.o_totalprice > 2000000.", s.evaluate)
    return found[1].select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0.04")
def repair_skip(spark, sf_dir):
    """A degraded run: the reviewer's verdict leaves incomplete rows out."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "nullif(l_tax, 0.04D) AS tax")
    _, repair = triage.self_repair("unsupported codec in part 3", "risk", ["risk"])
    return triage.apply_repair(rows, repair)[0].select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, {_DEEP_SQL} AS p FROM lineitem WHERE l_quantity > 40")
def repair_swap(spark, sf_dir):
    """A recoverable error: the rows are scored by the other model."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    _, repair = triage.self_repair("shape mismatch at the input", "risk", ["risk", "deep"])
    models = {"deep": _DEEP}
    scored, _ = triage.apply_repair(rows, repair, lambda f, m: f.withColumn("p", F.round(models[m].score([F.col(c) for c in models[m].features]), 3)))
    return scored.select("l_orderkey", "l_linenumber", "p")


@query("SELECT n_nationkey AS row, 'row ' || n_nationkey || ': query_pipeline:sql:[row_' || n_nationkey || ']' AS text FROM nation")
def reasoning_text(spark, sf_dir):
    frame = session(spark, sf_dir, provenance="polynomial").sql(_NATION).frame
    return spark.createDataFrame(list(enumerate(explainer.reasoning(frame, "polynomial"))), "row int, text string")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def refine_query(spark, sf_dir):
    """The last query again, under a rule that a text model makes of a request."""
    s = session(spark, sf_dir)
    s.sql("SELECT o_orderkey, o_totalprice FROM orders")
    return s.refine("only the large ones", lambda prompt: "o_totalprice > 150000").frame


@query("SELECT r_regionkey, r_name, n_nationkey AS k FROM region, nation")
def datalog_product(spark, sf_dir):
    return datalog.natural_join(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")))


@query("SELECT role, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'cuda' ELSE 'cpu' END AS role FROM nation) GROUP BY 1")
def device_slots(spark, sf_dir):
    """Requests of nations for a device; a kind that there is none of takes the least loaded slot."""
    pool = placement.DevicePool([placement.Slot("a", "cpu"), placement.Slot("b", "cuda")])
    kinds = [("cuda" if r["n_nationkey"] % 3 == 0 else "cpu") for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(pool.request(k).kind,) for k in kinds], "role string").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_ingest(spark, sf_dir):
    path = Store(spark, "nation-json").path
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.json(f"{path}/in.json")
    return ingest_frame(read_any(spark, f"{path}/in.json"), f"{path}/out").select("n_nationkey", "n_name")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def orc_ingest(spark, sf_dir):
    path = Store(spark, "supplier-orc").path
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.orc(f"{path}/in.orc")
    return ingest_frame(read_any(spark, f"{path}/in.orc"), f"{path}/out")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
def versioned_overwrite(spark, sf_dir):
    t = _versions(spark, sf_dir)
    t.overwrite(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").filter("n_regionkey = 3"))
    return t.read()


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_round_trip(spark, sf_dir):
    """A result as an Arrow stream, read again."""
    return spark.createDataFrame(from_arrow_stream(to_arrow_stream(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))))


# more functions -------------------------------------------------------------------------------------------------------
same_sql("fn_vector_distance", f"SELECT h.vec_id AS vec_id, round(sqrt({_sum_sql(f'pow({_e("h")} - {_e("t")}, 2)')}), 4) AS d FROM embeddings h JOIN embeddings t ON t.vec_id = h.vec_id + 1",
         "SELECT h.vec_id AS vec_id, round(vector_distance(cast(h.embedding AS array<double>), cast(t.embedding AS array<double>)), 4) AS d FROM embeddings h JOIN embeddings t ON t.vec_id = h.vec_id + 1")
same_sql("fn_spatial_distance", "SELECT p_partkey, round(sqrt(pow(p_size - 4, 2) + pow(p_retailprice - 900, 2) + 9), 6) AS d FROM part",
         "SELECT p_partkey, round(spatial_distance(named_struct('x', double(p_size), 'y', p_retailprice, 'z', 0D), named_struct('x', 4D, 'y', 900D, 'z', 3D)), 6) AS d FROM part")
same_sql("fn_audio_tempo", "SELECT user_id, round(CASE WHEN count(*) >= 2 AND max(hour(ts)) > min(hour(ts)) THEN 60 * (count(*) - 1) / (max(hour(ts)) - min(hour(ts))) END, 6) AS t FROM events GROUP BY 1",
         "SELECT user_id, round(audio_tempo(e), 6) AS t FROM (SELECT user_id, collect_list(named_struct('label', event_type, 'start', double(hour(ts)), 'end', double(hour(ts) + 1), 'confidence', 1D)) AS e FROM events GROUP BY 1)")
same_sql("sql_natural_join", "SELECT c_custkey, n_name FROM (SELECT c_custkey, c_nationkey AS k FROM customer) NATURAL JOIN (SELECT n_nationkey AS k, n_name FROM nation)",
         "SELECT c_custkey, n_name FROM (SELECT c_custkey, c_nationkey AS k FROM customer) a NATURAL JOIN (SELECT n_nationkey AS k, n_name FROM nation) b")
same_sql("sql_window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
same_sql("sql_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events",
         "SELECT event_id, cast(get_json_object(props, '$.k') AS bigint) AS k, get_json_object(props, '$.none') AS none FROM events")
same_sql("sql_json_struct", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS g, count(*) AS n FROM events GROUP BY 1", "SELECT from_json(props, 'k BIGINT').k % 10 AS g, count(*) AS n FROM events GROUP BY 1")
same_sql("sql_struct", "SELECT o_orderkey, x.a AS a, x.b AS b FROM (SELECT o_orderkey, {'a': o_orderstatus, 'b': o_custkey} AS x FROM orders)", "SELECT o_orderkey, x.a AS a, x.b AS b FROM (SELECT o_orderkey, named_struct('a', o_orderstatus, 'b', o_custkey) AS x FROM orders)")
same_sql("sql_map", "SELECT o_orderkey, CAST(cardinality(m) AS BIGINT) AS n, map_keys(m)[1] AS k, map_values(m)[2] AS v FROM (SELECT o_orderkey, map([o_orderstatus, 'all'], [o_custkey, o_orderkey]) AS m FROM orders)",
         "SELECT o_orderkey, bigint(cardinality(m)) AS n, map_keys(m)[0] AS k, map_values(m)[1] AS v FROM (SELECT o_orderkey, map(o_orderstatus, o_custkey, 'all', o_orderkey) AS m FROM orders)")
same_sql("sql_encode", "SELECT c_custkey, hex(c_name) AS h, base64(encode(c_name)) AS b, decode(unhex(hex(c_name))) AS d, url_encode(c_name) AS u FROM customer",
         "SELECT c_custkey, hex(c_name) AS h, base64(encode(c_name, 'UTF-8')) AS b, decode(unhex(hex(c_name)), 'UTF-8') AS d, url_encode(c_name) AS u FROM customer")
same_sql("sql_array_sets", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(a)), ',') AS d, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(a[2:3], ',') AS s, CAST(list_position(a, 2) AS BIGINT) AS p, CAST(list_sum(a) AS BIGINT) AS t"
         " FROM (SELECT o_orderkey, [o_orderkey % 3, o_custkey % 3, 2, o_orderkey % 5] AS a, [0, 2, 4] AS b FROM orders)",
         "SELECT o_orderkey, array_join(array_sort(array_distinct(a)), ',') AS d, array_join(array_sort(array_intersect(a, b)), ',') AS i, array_join(slice(a, 2, 2), ',') AS s, array_position(a, 2L) AS p, aggregate(a, 0L, (s, x) -> s + x) AS t"
         " FROM (SELECT o_orderkey, array(o_orderkey % 3, o_custkey % 3, 2L, o_orderkey % 5) AS a, array(0L, 2L, 4L) AS b FROM orders)")  # fmt: skip
same_sql("sql_trig", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_tax), 6) AS c, round(atan2(l_quantity, l_linenumber), 6) AS a, round(exp(l_discount), 6) AS e, round(degrees(l_tax), 6) AS d, round(radians(l_quantity), 6) AS r, CAST(factorial(l_linenumber) AS BIGINT) AS f FROM lineitem",
         "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) AS s, round(cos(l_tax), 6) AS c, round(atan2(l_quantity, l_linenumber), 6) AS a, round(exp(l_discount), 6) AS e, round(degrees(l_tax), 6) AS d, round(radians(l_quantity), 6) AS r, factorial(int(l_linenumber)) AS f FROM lineitem")
same_sql("sql_regexp_count", "SELECT p_partkey, len(regexp_extract_all(p_type, '[AEIOU]')) AS n, regexp_full_match(p_brand, '(Brand)#[0-9]+') AS m FROM part", "SELECT p_partkey, bigint(regexp_count(p_type, '[AEIOU]')) AS n, p_brand RLIKE '^(Brand)#[0-9]+$' AS m FROM part")


# statements and rules that use each other -----------------------------------------------------------------------------
@query(f"WITH RECURSIVE e AS ({_EDGES}), p(x, y, odd) AS (SELECT a, b, true FROM e UNION SELECT p.x, e.b, NOT p.odd FROM p JOIN e ON p.y = e.a) SELECT x AS \"A\", y AS \"C\" FROM p WHERE NOT odd")
def datalog_mutual_recursion(spark, sf_dir):
    """Pairs of nations joined by a path of an even number of edges."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    edges = n.selectExpr("n_nationkey AS a", "(n_nationkey * 2 + 1) % 25 AS b").union(n.selectExpr("n_nationkey", "(n_nationkey + 10) % 25")).distinct()
    s = session(spark, sf_dir, ("odd(A, B) :- edges(A, B).", "odd(A, C) :- even(A, B), edges(B, C)."))
    s.add_facts("edges", edges)
    return s.evaluate("even(A, C) :- odd(A, B), edges(B, C).")


@query("SELECT 'event-quality' AS name, '1.0.0' AS version")
def hub_search(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        return Session(spark, Config(provenance="none"), hub=folder).sql("SELECT hub_search('monitoring') AS packs").frame.select("name", "version")


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.08 AND l_quantity > 30")
def hub_install(spark, sf_dir):
    """The rule of an installed pack, evaluated."""
    with tempfile.TemporaryDirectory() as folder:
        s = session(spark, sf_dir)
        s.hub = Hub(folder)
        s.sql("SELECT hub_install('discount-review@1.0.0') AS result").frame.count()
    return s.evaluate("deep_discount").agg(F.count("*").alias("n"))


def _labelled(spark, sf_dir) -> Session:
    s = session(spark, sf_dir)
    s.register_table("labelled", table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "bigint(l_quantity > 25) AS label"))
    s.register_model(LinearOperator("large", [0.0], 0.0, features=["l_quantity"]), "large-1")
    return s


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS BIGINT) AS large FROM lineitem")
def finetune_model(spark, sf_dir):
    """A model of no knowledge, fine-tuned to tell quantities over 25; its classes are the labels."""
    s = _labelled(spark, sf_dir)
    s.sql("SELECT finetune_model('large', target_table => 'labelled', epochs => 8) AS id")
    return s.sql("PREDICT CLASS OF large FROM labelled WITH (model = 'large')").frame.selectExpr("l_orderkey", "l_linenumber", "prediction_large AS large")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS BIGINT) AS large FROM lineitem")
def distill_model(spark, sf_dir):
    """A student of a teacher that tells quantities over 25; its classes are the teacher's."""
    s = _labelled(spark, sf_dir)
    s.register_model(LinearOperator("teacher", [0.5], -12.75, features=["l_quantity"]), "teacher-1")
    s.sql("SELECT distill_model('teacher', target_table => 'labelled', name => 'student') AS id")
    return s.sql("PREDICT CLASS OF large FROM labelled WITH (model = 'student')").frame.selectExpr("l_orderkey", "l_linenumber", "prediction_large AS large")

"""The registered queries: each a statement of the dialect over views of the given tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import partial
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from . import rules
from .errors import ExecError
from .functions.types import Kind, Literal
from .plans.nodes import ColumnRef, Comparison, Select, Value
from .plans.parser import parse
from .plans.render import literal_sql
from .session import Session

#: View: (key column or None, columns, Spark SQL and DuckDB SQL over the Parquet tables; {t} is a table).
VIEWS: dict[str, tuple[str | None, str]] = {
    "customers": ("id", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS city FROM customer"),
    "shop_orders": ("oid", "SELECT o_orderkey AS oid, o_custkey AS customer, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, CAST(DAYOFYEAR(o_orderdate) AS INT) AS day, o_orderstatus AS status, o_orderpriority AS priority FROM orders"),
    "items": (None, "SELECT l_orderkey AS oid, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, CAST(ROUND(l_quantity) AS INT) AS quantity, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag, l_linestatus AS status FROM lineitem"),
    "parts": ("id", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size FROM part"),
    "suppliers": ("id", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier"),
    "nations": ("id", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM nation"),
    "regions": ("id", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region"),
    "clicks": ("id", "SELECT event_id AS id, user_id AS who, event_type AS kind, CAST(ROUND(value * 100) AS BIGINT) AS amount FROM events"),
    "docs": ("doc_id", "SELECT doc_id, text AS body, lang, source, n_chars FROM documents"),
    "marks": ("doc_id", "SELECT doc_id, quality, toxic FROM labels"),
    "turns": (None, "SELECT conv_id, turn, role, text AS body FROM conversations"),
    "t_nulls": ("id", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS a, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS f FROM customer"),
    "u_nulls": ("id", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_custkey END AS t_id, CAST(o_orderkey % 50 AS INT) AS w FROM orders"),
    "c_clustered": ("id", "SELECT event_id AS id, CAST(FLOOR(event_id / 100) AS BIGINT) AS day, CASE WHEN event_id % 25 = 0 THEN NULL ELSE event_id * 7919 % 1000 END AS v FROM events"),
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

INDEXES = (("shop_orders", "customer"), ("shop_orders", "cents"), ("customers", "city"), ("t_nulls", "a"), ("t_nulls", "s"), ("u_nulls", "t_id"))

STATEMENTS: dict[str, str] = {
    # Scans and projection
    "scan_star": "SELECT * FROM customers",
    "scan_columns": "SELECT name, id FROM customers",
    "project_repeat": "SELECT id, city AS first, city AS second FROM customers",
    # The six comparisons, literal families, NULL
    "filter_eq": "SELECT id, a FROM t_nulls WHERE a = 7",
    "filter_ne": "SELECT id, a FROM t_nulls WHERE a <> 7",
    "filter_lt": "SELECT id, a FROM t_nulls WHERE a < 7",
    "filter_le": "SELECT id, a FROM t_nulls WHERE a <= 7",
    "filter_gt": "SELECT id, a FROM t_nulls WHERE a > 7",
    "filter_ge": "SELECT id, a FROM t_nulls WHERE a >= 7",
    "filter_text_cmp": "SELECT id, s FROM t_nulls WHERE s >= 'BUILDING' AND s < 'MACHINERY'",
    "filter_bool": "SELECT id, f FROM t_nulls WHERE f = TRUE",
    "filter_decimal_literal": "SELECT oid, cents FROM shop_orders WHERE cents > 9999999.5",
    "filter_col_col": "SELECT id, t_id FROM u_nulls WHERE t_id > w",
    "filter_null_literal": "SELECT id FROM t_nulls WHERE a = NULL",
    "filter_ne_null": "SELECT id FROM t_nulls WHERE a <> NULL",
    "filter_and3": "SELECT id, a, s FROM t_nulls WHERE a > 3 AND a < 20 AND s = 'BUILDING'",
    "filter_contradiction": "SELECT id FROM t_nulls WHERE a > 10 AND a < 5",
    "filter_out_of_range": "SELECT id FROM t_nulls WHERE a < 3000000000",
    # Keys and indexes
    "key_lookup": "SELECT * FROM shop_orders WHERE oid = 4242",
    "key_range": "SELECT oid, day FROM shop_orders WHERE oid >= 100 AND oid < 300",
    "key_range_empty": "SELECT oid FROM shop_orders WHERE oid > 300 AND oid < 100",
    "secondary_eq": "SELECT oid, cents FROM shop_orders WHERE customer = 7",
    "secondary_range": "SELECT oid, cents FROM shop_orders WHERE cents >= 10000000 AND cents <= 12000000",
    # Joins
    "join_equi": "SELECT o.oid, c.name FROM shop_orders o JOIN customers c ON o.customer = c.id",
    "join_two_keys": "SELECT a.oid, a.line, b.cents FROM items a JOIN items b ON a.oid = b.oid AND a.line = b.line WHERE a.quantity > 48",
    "join_residual": "SELECT o.oid, c.id FROM shop_orders o JOIN customers c ON o.customer = c.id AND o.day > c.nation",
    "join_theta": "SELECT a.id AS low, b.id AS high FROM nations a JOIN nations b ON a.id < b.id",
    "join_self": "SELECT a.oid AS one, b.oid AS other FROM shop_orders a JOIN shop_orders b ON a.customer = b.customer WHERE a.oid < b.oid AND a.day = 100",
    "join_text": "SELECT a.id, b.name FROM nations a JOIN nations b ON a.name = b.name",
    "join_three_way": "SELECT c.name, o.oid, i.line FROM customers c JOIN shop_orders o ON o.customer = c.id JOIN items i ON i.oid = o.oid WHERE c.nation = 3",
    "join_five_way": "SELECT r.name, COUNT(*) AS n, SUM(i.cents) AS cents FROM regions r JOIN nations n ON n.region = r.id JOIN customers c ON c.nation = n.id JOIN shop_orders o ON o.customer = c.id JOIN items i ON i.oid = o.oid GROUP BY r.name",
    "join_null_keys": "SELECT u.id, t.s FROM u_nulls u JOIN t_nulls t ON u.t_id = t.id",
    "join_null_groups": "SELECT a.a, a.s, COUNT(*) AS pairs, SUM(b.id) AS ids FROM t_nulls a JOIN t_nulls b ON a.a = b.a AND a.s = b.s GROUP BY a.a, a.s",
    "join_int_widen": "SELECT c.id, n.name FROM customers c JOIN nations n ON c.nation = n.id",
    "join_star": "SELECT * FROM nations n JOIN regions r ON n.region = r.id",
    "join_on_local_term": "SELECT o.oid FROM shop_orders o JOIN customers c ON o.customer = c.id AND c.city = 'BUILDING' AND o.day = 17",
    # Grouping
    "agg_global": "SELECT COUNT(*), SUM(cents), AVG(cents), MIN(cents), MAX(cents) FROM shop_orders",
    "agg_empty": "SELECT COUNT(*), COUNT(cents), SUM(cents), AVG(cents), MIN(status), MAX(day) FROM shop_orders WHERE oid < 0",
    "agg_all_null": "SELECT COUNT(*), COUNT(v), SUM(v), AVG(v), MIN(v) FROM c_clustered WHERE v = NULL",
    "agg_count_col": "SELECT COUNT(a), COUNT(s), COUNT(f), COUNT(*) FROM t_nulls",
    "agg_sum": "SELECT SUM(a), SUM(id) FROM t_nulls",
    "agg_avg": "SELECT AVG(v), AVG(day) FROM c_clustered",
    "agg_min_max_text": "SELECT MIN(s), MAX(s), MIN(id), MAX(a) FROM t_nulls",
    "agg_min_max_bool": "SELECT MIN(f), MAX(f) FROM t_nulls",
    "agg_body_bytes": "SELECT MIN(body), MAX(body) FROM docs",
    "group_one": "SELECT city, COUNT(*) AS n FROM customers GROUP BY city",
    "group_two": "SELECT lang, source, COUNT(*) AS n, SUM(n_chars) AS chars FROM docs GROUP BY lang, source",
    "group_null_key": "SELECT a, COUNT(*) AS n, SUM(id) AS ids FROM t_nulls GROUP BY a",
    "group_null_bool": "SELECT f, s, COUNT(*) AS n FROM t_nulls GROUP BY f, s",
    "group_dup_key": "SELECT a, MAX(id) AS top FROM t_nulls GROUP BY a, a",
    "group_no_aggregate": "SELECT kind FROM clicks GROUP BY kind",
    "group_join": "SELECT c.city, COUNT(*) AS orders, SUM(o.cents) AS revenue, AVG(o.cents) AS avg_order FROM shop_orders o JOIN customers c ON o.customer = c.id GROUP BY c.city",
    "group_many": "SELECT who, COUNT(*) AS n, AVG(amount) AS mean FROM clicks GROUP BY who",
    "group_labels": "SELECT m.toxic, d.lang, COUNT(*) AS n FROM docs d JOIN marks m ON d.doc_id = m.doc_id GROUP BY m.toxic, d.lang",
    "group_turns": "SELECT role, COUNT(*) AS n, MAX(turn) AS last FROM turns GROUP BY role",
    "having_count": "SELECT customer, COUNT(*) AS n FROM shop_orders GROUP BY customer HAVING COUNT(*) >= 15",
    "having_unselected_agg": "SELECT city FROM customers GROUP BY city HAVING MAX(nation) >= 20 AND COUNT(*) > 1",
    "having_group_col": "SELECT a, COUNT(*) AS n FROM t_nulls GROUP BY a HAVING a > 12",
    "having_avg_decimal": "SELECT day, AVG(v) AS mean FROM c_clustered GROUP BY day HAVING AVG(v) > 499.5",
    "having_no_group": "SELECT COUNT(*) FROM customers HAVING COUNT(*) > 1",
    "having_null_sum": "SELECT a, SUM(id) AS ids FROM t_nulls GROUP BY a HAVING SUM(id) <> NULL",
    # Order and limit
    "order_asc_nulls": "SELECT id, a FROM t_nulls ORDER BY a, id",
    "order_desc_nulls": "SELECT id, a FROM t_nulls ORDER BY a DESC, id",
    "order_multi": "SELECT id, s, f, a FROM t_nulls ORDER BY s DESC, f, a DESC, id",
    "order_alias": "SELECT customer AS who, SUM(cents) AS spent FROM shop_orders GROUP BY customer ORDER BY spent DESC, who LIMIT 20",
    "order_agg": "SELECT priority, COUNT(*) AS n FROM shop_orders GROUP BY priority ORDER BY COUNT(*) DESC, priority LIMIT 3",
    "order_unselected": "SELECT name FROM customers ORDER BY nation DESC, id",
    "order_text_bytes": "SELECT doc_id, lang FROM docs ORDER BY body, doc_id",
    "order_hidden_tie": "SELECT oid, day FROM shop_orders ORDER BY day LIMIT 50",
    "topn": "SELECT oid, cents FROM shop_orders ORDER BY cents DESC, oid LIMIT 10",
    "topn_beyond": "SELECT id, name FROM regions ORDER BY name LIMIT 5000",
    "limit_zero": "SELECT id FROM customers ORDER BY id LIMIT 0",
    "limit_all": "SELECT id FROM nations LIMIT 1000",
    "minmax_ends": "SELECT MIN(oid), MAX(oid), MIN(cents), MAX(cents) FROM shop_orders",
    # Reports over the test tables
    "report_lines": "SELECT flag, status, SUM(quantity) AS units, SUM(cents) AS cents, AVG(quantity) AS mean, COUNT(*) AS n FROM items GROUP BY flag, status ORDER BY flag, status",
    "report_brands": "SELECT p.brand, SUM(i.cents) AS revenue, COUNT(*) AS n FROM items i JOIN parts p ON i.part = p.id WHERE i.quantity >= 30 GROUP BY p.brand HAVING COUNT(*) > 5 ORDER BY revenue DESC, p.brand LIMIT 8",
    "report_suppliers": "SELECT r.name, n.name, COUNT(*) AS suppliers, MIN(s.id) AS first FROM suppliers s JOIN nations n ON s.nation = n.id JOIN regions r ON n.region = r.id GROUP BY r.name, n.name ORDER BY r.name, n.name",
    "report_priorities": "SELECT priority, status, COUNT(*) AS n, AVG(cents) AS mean FROM shop_orders GROUP BY priority, status ORDER BY priority, status",
    "report_clicks": "SELECT kind, COUNT(*) AS n, COUNT(amount) AS valued, MIN(amount), MAX(amount) FROM clicks GROUP BY kind HAVING COUNT(*) >= 10 ORDER BY n DESC, kind",
    "report_sources": "SELECT d.source, m.quality, COUNT(*) AS n, SUM(d.n_chars) AS chars FROM docs d JOIN marks m ON d.doc_id = m.doc_id GROUP BY d.source, m.quality ORDER BY chars DESC, d.source, m.quality LIMIT 12",
    "report_one_order": "SELECT i.line, p.name, s.name, i.cents FROM items i JOIN parts p ON i.part = p.id JOIN suppliers s ON i.supplier = s.id WHERE i.oid = 77 ORDER BY i.line",
    "report_neighbours": "SELECT a.id AS one, b.id AS other FROM suppliers a JOIN suppliers b ON a.nation = b.nation AND a.id < b.id ORDER BY one, other",
    "report_season": "SELECT c.nation, SUM(o.cents) AS spent FROM customers c JOIN shop_orders o ON o.customer = c.id WHERE o.day >= 100 AND o.day < 200 AND c.city <> 'BUILDING' GROUP BY c.nation HAVING SUM(o.cents) > 100000000 ORDER BY spent DESC, c.nation",
    "report_sizes": "SELECT COUNT(*), AVG(size), MIN(brand), MAX(kind) FROM parts WHERE size > 20 AND size <= 35.5",
    "report_turns": "SELECT role, turn, COUNT(*) AS n FROM turns GROUP BY role, turn ORDER BY n DESC, role, turn LIMIT 15",
    "report_keys": "SELECT COUNT(*), MIN(id), MAX(id), MIN(size), MAX(size) FROM parts",
}

#: Queries that force a join algorithm; the answer is that of the plain plan.
FORCED: dict[str, tuple[str, str]] = {
    "join_hint_nl": ("nested_loop", "SELECT a.id, b.name FROM nations a JOIN regions b ON a.region = b.id"),
    "join_hint_hash_right": ("hash", STATEMENTS["join_equi"]),
    "join_hint_hash_left": ("hash_left", STATEMENTS["join_residual"]),
    "join_hint_index": ("index_nested_loop", STATEMENTS["join_int_widen"]),
    "join_hint_index_left": ("index_nested_loop", "SELECT c.id, n.name FROM customers c JOIN nations n ON c.id = n.region"),
}

#: Statements run in one session without files; the last one's rows are the result.
SCRIPTS: dict[str, list[str]] = {
    "insert_select": ["CREATE TABLE t (id INT64 NOT NULL, a INT32, s TEXT, f BOOL)", "BEGIN", "INSERT INTO t VALUES (1, 5, 'x', TRUE)", "INSERT INTO t VALUES (2, NULL, 'it''s', FALSE)", "INSERT INTO t VALUES (-3, -7, NULL, NULL)", "SELECT id, a, s, f FROM t"],
    "txn_commit": ["CREATE TABLE t (id INT64, v INT64)", "BEGIN", "INSERT INTO t VALUES (1, 10)", "INSERT INTO t VALUES (2, 20)", "COMMIT", "SELECT COUNT(*) AS n, SUM(v) AS total FROM t"],
    "txn_rollback": ["CREATE TABLE t (id INT64, v INT64)", "INSERT INTO t VALUES (1, 10)", "BEGIN", "INSERT INTO t VALUES (2, 20)", "ROLLBACK", "SELECT COUNT(*) AS n, SUM(v) AS total FROM t"],
    "txn_index": ["CREATE TABLE t (id INT64, v INT64)", "BEGIN", "CREATE INDEX ON t (v)", "INSERT INTO t VALUES (1, 30)", "INSERT INTO t VALUES (2, 20)", "INSERT INTO t VALUES (3, NULL)", "COMMIT", "SELECT id, v FROM t WHERE v >= 20 ORDER BY v"],
}
SCRIPT_SQL = {
    "insert_select": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(5 AS INTEGER), 'x', TRUE), (2, NULL, 'it''s', FALSE), (-3, -7, NULL, NULL)) v(id, a, s, f)",
    "txn_commit": "SELECT CAST(2 AS BIGINT) AS n, CAST(30 AS BIGINT) AS total",
    "txn_rollback": "SELECT CAST(1 AS BIGINT) AS n, CAST(10 AS BIGINT) AS total",
    "txn_conflict": "SELECT CAST(2 AS BIGINT) AS id, CAST(20 AS BIGINT) AS v",
    "txn_index": "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(20 AS BIGINT)), (1, 30)) v(id, v)",
}


def shop(spark: SparkSession, sf_dir: str, names: set[str] | None = None) -> Session:
    """A session with the views registered; each view is a projection, so scans read only the columns a query names."""
    session = Session(spark)
    for name, (key, sql) in VIEWS.items():
        if names is None or name in names:
            columns, table = sql.removeprefix("SELECT ").rsplit(" FROM ", 1)
            session.register(name, f"{sf_dir}/{table}.parquet", key, columns=split_columns(columns))
    for name, column in INDEXES:
        if name in session.external:
            session.sql(f"CREATE INDEX ON {name} ({column})")
    return session


def _used(sql: str) -> set[str]:
    return {t.name for t in parse(sql).tables}


def _statement(sql: str, algorithm: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    session = shop(spark, sf_dir, _used(sql))
    session.join_algorithm = algorithm
    return session.sql(sql)


@contextmanager
def _database(spark: SparkSession) -> Iterator[str]:
    """A folder for a small database, gone afterwards: in the shared folder where the cluster names one."""
    shared = urlsplit(spark.conf.get("spark.checkpoint.dir", None) or "")
    if shared.scheme not in ("", "file"):
        raise ValueError("a database needs a folder that driver and executors mount; spark.checkpoint.dir names none")
    if shared.path:
        os.makedirs(shared.path, exist_ok=True)
    path = tempfile.mkdtemp(prefix="tessera-db-", dir=shared.path or None)
    try:
        yield path
    finally:
        shutil.rmtree(path)


def _script(statements: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    # The rows are a few literals; they are read back and the store is gone before the query returns.
    with _database(spark) as path, Session(spark, path) as session:
        for s in statements[:-1]:
            session.sql(s)
        df = session.sql(statements[-1])
        return spark.createDataFrame(df.toArrow(), df.schema)


def _conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions write at once: the second COMMIT fails, and its session shows the first one's rows only."""
    with _database(spark) as path, Session(spark, path) as one:
        one.sql("CREATE TABLE t (id INT64, v INT64)")
        with Session(spark, path) as two:
            for s in ("BEGIN", "INSERT INTO t VALUES (1, 10)"):
                two.sql(s)
            one.sql("INSERT INTO t VALUES (2, 20)")
            with suppress(ExecError):
                two.sql("COMMIT")
            df = two.sql("SELECT id, v FROM t")
            return spark.createDataFrame(df.toArrow(), df.schema)


def _rule(steps: list[tuple[str, str]], spark: SparkSession, sf_dir: str) -> DataFrame:
    with _database(spark) as path:
        return rules.run(spark, path, steps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: partial(_statement, sql, "auto") for name, sql in STATEMENTS.items()}
    out |= {name: partial(_statement, sql, algorithm) for name, (algorithm, sql) in FORCED.items()}
    return out | {name: partial(_script, statements) for name, statements in SCRIPTS.items()} | {"txn_conflict": _conflict} | {name: partial(_rule, steps) for name, steps in rules.RULES.items()}


# The same statements for DuckDB.


def _duck_value(v: Value) -> str:
    if not v.func:
        return _duck_ref(v.ref)
    x = "*" if v.ref is None else _duck_ref(v.ref)
    if v.func == "SUM":
        return f"CAST(SUM({x}) AS BIGINT)"
    if v.func == "AVG":
        return f"CAST(SUM({x}) AS DOUBLE) / COUNT({x})"
    return f"{v.func}({x})"


def _duck_ref(r: ColumnRef) -> str:
    return f'{r.table}."{r.column}"' if r.table else f'"{r.column}"'


def _duck_terms(terms: tuple[Comparison, ...]) -> str:
    def right(c: Comparison) -> str:
        if not isinstance(c.right, Literal):
            return _duck_ref(c.right)
        return f"CAST({literal_sql(c.right)} AS DOUBLE)" if c.right.kind is Kind.DOUBLE else literal_sql(c.right)

    return " AND ".join(f"{_duck_value(c.left)} {c.op} {right(c)}" for c in terms)


def duck_sql(sql: str) -> str:
    """A SELECT of the dialect as DuckDB runs it on the raw tables: exact sums, spelled NULL order, hidden ties."""
    s = parse(sql)
    assert isinstance(s, Select)
    if s.items:
        shown = ", ".join(f'{_duck_value(i.value)} AS "{i.alias or _heading(i.value)}"' for i in s.items)
    elif s.joins:
        shown = ", ".join(f'{t.label}."{c}" AS "{t.label}.{c}"' for t in s.tables for c in _view_columns(t.name))
    else:
        shown = "*"
    parts = [f"SELECT {shown} FROM {s.source.name} {s.source.label}"]
    parts += [f"JOIN {j.table.name} {j.table.label} ON {_duck_terms(j.on)}" for j in s.joins]
    if s.where:
        parts.append("WHERE " + _duck_terms(s.where))
    if s.group_by:
        parts.append("GROUP BY " + ", ".join(map(_duck_ref, s.group_by)))
    if s.having:
        parts.append("HAVING " + _duck_terms(s.having))
    if s.order_by:
        keys = [f"{_duck_value(o.value)} {'DESC NULLS FIRST' if o.descending else 'ASC NULLS LAST'}" for o in s.order_by]
        if not s.group_by and not s.joins and VIEWS[s.source.name][0]:
            keys.append(f'"{VIEWS[s.source.name][0]}"')
        parts.append("ORDER BY " + ", ".join(keys))
    if s.limit is not None:
        parts.append(f"LIMIT {s.limit}")
    views = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in sorted(_used(sql)))
    return f"WITH {views} " + " ".join(parts)


def _heading(v: Value) -> str:
    inner = "*" if v.ref is None else (f"{v.ref.table}.{v.ref.column}" if v.ref.table else v.ref.column)
    return f"{v.func}({inner})" if v.func else inner


def split_columns(body: str) -> list[str]:
    """The expressions of a select list, split at commas outside parentheses."""
    depth, parts, last = 0, [], ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(last)
            last = ""
        else:
            last += c
    return [p.strip() for p in [*parts, last]]


def _view_columns(name: str) -> list[str]:
    body = VIEWS[name][1].removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    return [p.rsplit(" ", 1)[-1] for p in split_columns(body)]


def oracle_sql() -> dict[str, str]:
    out = {name: duck_sql(sql) for name, sql in STATEMENTS.items()}
    return out | {name: duck_sql(sql) for name, (_, sql) in FORCED.items()} | SCRIPT_SQL | {name: rules.oracle(steps) for name, steps in rules.RULES.items()}

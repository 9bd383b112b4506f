from __future__ import annotations

import duckdb
import pytest

import tessera
from tessera import ExecError, Session, queries
from tessera.errors import LimitError


@pytest.fixture
def db(spark):
    s = Session(spark, deterministic=True)
    s.register("t", spark.createDataFrame([(1, 5, "b", True), (2, None, "a", False), (3, 5, None, None), (4, 1, "é", True)], "id long, a int, s string, f boolean"), key="id")
    s.register("u", spark.createDataFrame([(10, 1, 7), (11, 1, 8), (12, None, 9), (13, 9, 2)], "id long, t_id long, w int"), key="id")
    return s


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT id FROM t WHERE a = NULL", []),
        ("SELECT id FROM t WHERE a <> NULL", []),
        ("SELECT id FROM t WHERE a <> 5", [(4,)]),
        ("SELECT id FROM t WHERE a >= 1.5", [(1,), (3,)]),
        ("SELECT id FROM t WHERE a < 99999999999", [(1,), (3,), (4,)]),
        ("SELECT id FROM t WHERE s > 'b'", [(4,)]),
        ("SELECT id, a FROM t ORDER BY a", [(4, 1), (1, 5), (3, 5), (2, None)]),
        ("SELECT id, a FROM t ORDER BY a DESC", [(2, None), (1, 5), (3, 5), (4, 1)]),
        ("SELECT id FROM t ORDER BY f DESC, s LIMIT 2", [(3,), (1,)]),
        ("SELECT a, COUNT(*) FROM t GROUP BY a", [(5, 2), (None, 1), (1, 1)]),
        ("SELECT COUNT(*), COUNT(a), SUM(a), AVG(a), MIN(s), MAX(f) FROM t", [(4, 3, 11, 11 / 3, "a", True)]),
        ("SELECT COUNT(*), SUM(a), AVG(a) FROM t WHERE id > 99", [(0, None, None)]),
        ("SELECT t.id, u.w FROM t JOIN u ON u.t_id = t.id", [(1, 7), (1, 8)]),
        ("SELECT a.id, b.id FROM t a JOIN t b ON a.a = b.a AND a.id < b.id", [(1, 3)]),
        ("SELECT a FROM t GROUP BY a HAVING COUNT(*) > 1", [(5,)]),
        ("SELECT a AS x FROM t GROUP BY a ORDER BY x DESC LIMIT 1", [(None,)]),
        ("SELECT COUNT(*) FROM t HAVING COUNT(*) > 9", []),
        ("SELECT id FROM t LIMIT 0", []),
        ("SELECT id FROM t WHERE a > 10 AND a < 5", []),
    ],
)
def test_answers(db, sql, rows):
    assert db.query(sql).rows == rows


def test_star_headings(db):
    assert db.query("SELECT * FROM t").columns == ["id", "a", "s", "f"]
    assert db.query("SELECT * FROM t x JOIN u ON x.id = u.t_id").columns == ["x.id", "x.a", "x.s", "x.f", "u.id", "u.t_id", "u.w"]
    assert db.query("SELECT COUNT(*), SUM(t.a), id FROM t GROUP BY id").columns == ["COUNT(*)", "SUM(t.a)", "id"]


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT x FROM nope", "no such table: nope"),
        ("SELECT x FROM t", "no such column: x"),
        ("SELECT t.x FROM t", "no such column: t.x"),
        ("SELECT u.id FROM t", "no table named u is in scope for u.id"),
        ("SELECT t.id FROM t x", "no table named t is in scope for t.id"),
        ("SELECT id FROM t JOIN u ON t.id = u.t_id", "ambiguous column: id (qualify it with its table)"),
        ("SELECT * FROM t JOIN t ON id = id", "the name t refers to two tables; give one an alias"),
        ("SELECT t.id FROM t JOIN u ON t.id = v.id JOIN u v ON v.id = u.id", "no table named v is in scope for v.id"),
        ("SELECT id FROM t WHERE SUM(a) > 3", "aggregate functions are not allowed in WHERE or ON: SUM(a)"),
        ("SELECT id FROM t WHERE s = a", "cannot compare s (TEXT) with a (INT32)"),
        ("SELECT id FROM t WHERE a = 'x'", "type mismatch: a is INT32, compared with 'x'"),
        ("SELECT id FROM t WHERE s = 5", "type mismatch: s is TEXT, compared with 5"),
        ("SELECT id FROM t WHERE f = 1", "type mismatch: f is BOOL, compared with 1"),
        ("SELECT * FROM t GROUP BY a", "SELECT * cannot be used with GROUP BY or aggregates; name the columns"),
        ("SELECT SUM(s) FROM t", "SUM needs an integer column; s is TEXT"),
        ("SELECT AVG(f) FROM t", "AVG needs an integer column; f is BOOL"),
        ("SELECT id, COUNT(*) FROM t GROUP BY a", "column id must appear in GROUP BY or be used in an aggregate"),
        ("SELECT a AS x, COUNT(*) FROM t GROUP BY x", "no such column: x"),
        ("SELECT a AS x FROM t GROUP BY a HAVING x > 1", "no such column: x"),
        ("SELECT a FROM t GROUP BY a ORDER BY s", "column s must appear in GROUP BY or be used in an aggregate"),
        ("CREATE TABLE t (id INT64)", "table already exists: t"),
        ("CREATE INDEX ON t (id)", "column id is the key of t; the table's own B+Tree is already its index"),
        ("CREATE INDEX ON t (x)", "no such column: t.x"),
        ("COMMIT", "COMMIT without BEGIN"),
        ("ROLLBACK", "ROLLBACK without BEGIN"),
    ],
)
def test_refusals(db, sql, message):
    with pytest.raises(ExecError) as e:
        db.query(sql)
    assert e.value.message == message


def test_too_many_tables(db):
    joins = " ".join(f"JOIN t t{i} ON t{i}.id = t.id" for i in range(64))
    with pytest.raises(ExecError, match="a query may join at most 64 tables"):
        db.sql(f"SELECT t.id FROM t {joins}")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a.a, COUNT(*), COUNT(b.v), SUM(b.v), AVG(a.v), MIN(b.s), MAX(a.id) FROM m a JOIN m b ON a.a = b.a AND a.s = b.s GROUP BY a.a",
        "SELECT COUNT(*), SUM(a.v), AVG(b.a), MIN(a.v), MAX(b.v) FROM m a JOIN m b ON a.a < b.a WHERE a.id > 3 AND b.s = 'x'",
        "SELECT COUNT(*), COUNT(a.v), SUM(a.v), AVG(a.v), MIN(a.v) FROM m a JOIN m b ON a.a = b.a WHERE a.id > 999",
        "SELECT a.s, c.a FROM m a JOIN m b ON a.a = b.a JOIN m c ON b.s = c.s WHERE a.v <> c.v GROUP BY a.s, c.a HAVING COUNT(*) > 2 ORDER BY SUM(b.v) DESC, c.a, a.s",
        "SELECT COUNT(*), SUM(b.v) FROM m a JOIN m b ON a.id > 5",
        "SELECT k.id, COUNT(*), SUM(a.v), COUNT(k.v), SUM(k.v) FROM m a JOIN m b ON a.s = b.s JOIN m k ON k.id = a.a GROUP BY k.id",
    ],
)
def test_groups_made_before_a_join_are_those_made_after(spark, sql):
    rows = [(i, i % 4 if i % 7 else None, "xyz"[i % 3] if i % 5 else None, i * 3 - 40 if i % 6 else None) for i in range(40)]
    got = []
    for deterministic in (False, True):
        s = Session(spark, deterministic=deterministic)
        s.register("m", spark.createDataFrame(rows, "id long, a long, s string, v long"), key="id")
        df = s.sql(sql)
        assert ("t0rows" in df._jdf.queryExecution().optimizedPlan().toString()) is not deterministic
        got.append((sorted(map(tuple, df.collect()), key=repr), df.schema.simpleString()))
    assert got[0] == got[1]


def test_join_of_many_with_many_is_not_spelled_out(spark):
    """Every one of 2^20 rows meets 2^20 others: 2^40 pairs."""
    s = Session(spark)
    s.register("m", spark.range(1 << 20).selectExpr("id", "id % 1 AS a"), key="id")
    assert s.query("SELECT a.a, COUNT(*), SUM(b.id) FROM m a JOIN m b ON a.a = b.a GROUP BY a.a").rows == [(0, 1 << 40, (1 << 20) * ((1 << 20) - 1) // 2 << 20)]


def test_sums_of_joined_groups_overflow_by_what_joins(spark):
    s = Session(spark)
    s.register("big", spark.createDataFrame([(1, 7, 2**62), (2, 8, 2**62), (3, 8, 2**62), (4, 9, 2**62)], "id long, g long, v long"), key="id")
    s.register("few", spark.createDataFrame([(1, 7), (2, 9), (3, 9)], "id long, g long"), key="id")
    assert s.query("SELECT b.g, SUM(b.v) FROM big b JOIN few f ON b.g = f.g WHERE f.g < 9 GROUP BY b.g").rows == [(7, 2**62)]
    with pytest.raises(ExecError, match="integer overflow in SUM"):
        s.query("SELECT b.g, SUM(b.v) FROM big b JOIN few f ON b.g = f.g GROUP BY b.g")


def test_overflow_names_the_function(spark):
    s = Session(spark)
    s.register("big", spark.createDataFrame([(1, 2**63 - 1), (2, 1)], "id long, v long"), key="id")
    for func in ("SUM", "AVG"):
        with pytest.raises(ExecError, match=f"integer overflow in {func}"):
            s.query(f"SELECT {func}(v) FROM big")


def test_avg_is_exact(spark):
    s = Session(spark)
    s.register("v", spark.createDataFrame([(i, x) for i, x in enumerate([9007199254740992, 1, 1, 1, 1])], "id long, x long"), key="id")
    assert s.query("SELECT AVG(x) FROM v").rows == [(9007199254740996 / 5,)]


def test_decimal_compares_as_double(spark):
    s = Session(spark)
    s.register("v", spark.createDataFrame([(1, 9007199254740993)], "id long, x long"), key="id")
    assert s.query("SELECT id FROM v WHERE x = 9007199254740992.0").rows == [(1,)]


def test_forced_joins_agree(db):
    sql = "SELECT t.id, u.w FROM t JOIN u ON u.t_id = t.id AND u.w > t.a"
    want = sorted(db.query(sql).rows)
    for algorithm in ("nested_loop", "hash", "hash_left", "index_nested_loop"):
        db.join_algorithm = algorithm
        assert sorted(db.query(sql).rows) == want
    db.join_algorithm = "hash"
    with pytest.raises(ExecError, match=r"a hash join needs an ON equality between a column of each table: t.id < u.id"):
        db.sql("SELECT t.id FROM t JOIN u ON t.id < u.id")
    db.join_algorithm = "index_nested_loop"
    with pytest.raises(ExecError, match=r"no index to search for an index nested-loop join: t.a = u.w"):
        db.sql("SELECT t.id FROM t JOIN u ON t.a = u.w")


def test_plan_uses_pushdown_and_pruning(spark, sf):
    session = queries.shop(spark, sf, {"shop_orders", "customers"})
    plan = session.sql("SELECT name FROM customers WHERE id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
    top = session.sql("SELECT oid FROM shop_orders ORDER BY cents DESC LIMIT 3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def _duck(sf):
    c = duckdb.connect()
    for t in (*queries.TABLES, "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_query_matches_duckdb(spark, sf):
    c = _duck(sf)
    oracles = queries.oracle_sql()
    different = []
    for name, query in queries.queries().items():
        df = query(spark, sf)
        cur = c.execute(oracles[name])
        names = [d[0] for d in cur.description]
        order = [names.index(x) for x in df.columns]
        want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
        if sorted((tuple(r) for r in df.collect()), key=repr) != want or sorted(names) != sorted(df.columns):
            different.append(name)
    assert not different


# Storage and transactions.


def test_transactions_and_recovery(spark, tmp_path):
    path = str(tmp_path / "db")
    with Session(spark, path, deterministic=True) as s:
        s.script("CREATE TABLE t (id INT64 NOT NULL, v INT32, s TEXT); INSERT INTO t VALUES (1, 10, 'a''b'); BEGIN; INSERT INTO t VALUES (2, NULL, NULL)")
        assert s.query("SELECT COUNT(*) FROM t").rows == [(2,)]
        with pytest.raises(ExecError, match="BEGIN inside a transaction"):
            s.sql("BEGIN")
        assert s.in_transaction
        with pytest.raises(tessera.ParseError):
            s.sql("SELEC")
        assert s.in_transaction
        s.sql("ROLLBACK")
        assert s.query("SELECT COUNT(*) FROM t").rows == [(1,)]
        s.script("BEGIN; INSERT INTO t VALUES (3, 30, 'c'); CREATE TABLE gone (id INT64)")
        with pytest.raises(ExecError, match="duplicate key: t already has a row with id = 1"):
            s.sql("INSERT INTO t VALUES (1, 1, 'x')")
        assert not s.in_transaction
        assert s.table_names() == ["t"]
        s.script("BEGIN; INSERT INTO t VALUES (4, 40, 'd'); CREATE INDEX ON t (v); COMMIT; BEGIN; INSERT INTO t VALUES (5, 50, 'e')")
    with Session(spark, path, deterministic=True) as s:  # the open transaction is gone
        assert s.query("SELECT * FROM t").rows == [(1, 10, "a'b"), (4, 40, "d")]
        assert s.indexed("t") == ["v"]
        with pytest.raises(ExecError, match="column t.v already has an index"):
            s.sql("CREATE INDEX ON t (v)")
        before = s.query("SELECT id FROM t WHERE v >= 20").rows
        s.cluster("t", "v")
        assert s.query("SELECT id FROM t WHERE v >= 20").rows == before


def test_torn_and_stray_files_are_discarded(spark, tmp_path):
    path = tmp_path / "db"
    with Session(spark, str(path)) as s:
        s.script("CREATE TABLE t (id INT64); INSERT INTO t VALUES (1)")
        version = s.store.version
    (path / "_manifest" / f"{version + 1}.json").write_text('{"tables": {')
    (path / "t_t" / "stray.parquet").write_bytes(b"half")
    with Session(spark, str(path)) as s:
        assert s.store.recovery.discarded == 1
        assert s.query("SELECT id FROM t").rows == [(1,)]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    path = str(tmp_path / "db")
    one = Session(spark, path)
    one.sql("CREATE TABLE t (id INT64)")
    two = Session(spark, path)
    one.sql("INSERT INTO t VALUES (1)")
    with pytest.raises(ExecError, match="another session has committed"):
        two.sql("INSERT INTO t VALUES (2)")
    assert two.query("SELECT id FROM t").rows == [(1,)]


@pytest.mark.parametrize(
    ("values", "message"),
    [
        ("1, 2", "INSERT has 2 values but table t has 4 columns"),
        ("NULL, 1, 'a', TRUE", "NULL in non-nullable column id"),
        ("1, 1.5, 'a', TRUE", "type mismatch: column a expects INT32"),
        ("1, 2147483648, 'a', TRUE", "integer out of INT32 range for column a"),
        ("1, 1, 5, TRUE", "type mismatch: column s expects TEXT"),
        ("1, 1, 'a', 1", "type mismatch: column f expects BOOL"),
        ("'x', 1, 'a', TRUE", "type mismatch: column id expects INT64"),
    ],
)
def test_insert_refusals(spark, tmp_path, values, message):
    with Session(spark, str(tmp_path / "db")) as s:
        s.sql("CREATE TABLE t (id INT64 NOT NULL, a INT32, s TEXT, f BOOL)")
        with pytest.raises(ExecError) as e:
            s.sql(f"INSERT INTO t VALUES ({values})")
        assert e.value.message == message


def test_key_must_be_a_non_null_int64(spark, tmp_path):
    with Session(spark, str(tmp_path / "db")) as s:
        s.script("CREATE TABLE a (id INT64); CREATE TABLE b (id INT32)")
        for sql in ("INSERT INTO a VALUES (NULL)", "INSERT INTO b VALUES (1)"):
            with pytest.raises(ExecError, match=r"the key column \(column 0\) must be a non-null INT64"):
                s.sql(sql)


def test_strict_limits(spark, tmp_path):
    with Session(spark, str(tmp_path / "db")) as s:
        with pytest.raises(LimitError):
            s.sql("CREATE TABLE t (" + ", ".join(f"c{i} INT64" for i in range(9)) + ")")
        s.sql("CREATE TABLE t (id INT64, s TEXT)")
        with pytest.raises(LimitError):
            s.sql(f"INSERT INTO t VALUES (1, '{'x' * 5000}')")


def test_failed_commit_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "db")
    one = Session(spark, path)
    one.sql("CREATE TABLE t (id INT64)")
    two = Session(spark, path)
    two.script("BEGIN; INSERT INTO t VALUES (2)")
    one.sql("INSERT INTO t VALUES (1)")
    with pytest.raises(ExecError, match="another session has committed"):
        two.sql("COMMIT")
    assert not two.in_transaction
    assert two.query("SELECT id FROM t").rows == [(1,)]
    two.sql("INSERT INTO t VALUES (2)")
    assert sorted(Session(spark, path).query("SELECT id FROM t").rows) == [(1,), (2,)]


def test_a_session_without_a_path_keeps_what_is_committed(spark):
    s = Session(spark, deterministic=True)
    s.script("CREATE TABLE t (id INT64, v INT64); INSERT INTO t VALUES (1, 10); CREATE INDEX ON t (v)")
    with pytest.raises(ExecError, match="no such column: nope"):
        s.sql("SELECT nope FROM t")
    assert s.query("SELECT * FROM t").rows == [(1, 10)] and s.indexed("t") == ["v"]
    s.script("BEGIN; INSERT INTO t VALUES (2, 20)")
    with pytest.raises(ExecError, match="duplicate key"):
        s.sql("INSERT INTO t VALUES (1, 0)")
    assert s.query("SELECT * FROM t").rows == [(1, 10)]
    s.script("BEGIN; INSERT INTO t VALUES (2, 20); COMMIT")
    assert s.query("SELECT * FROM t").rows == [(1, 10), (2, 20)]


def test_clustering_waits_for_the_transaction(spark, tmp_path):
    with Session(spark, str(tmp_path / "db"), deterministic=True) as s:
        s.script("CREATE TABLE t (id INT64, v INT64); CREATE INDEX ON t (v); INSERT INTO t VALUES (1, 5); BEGIN; INSERT INTO t VALUES (2, 6)")
        with pytest.raises(ExecError, match="outside a transaction"):
            s.cluster("t", "v")
        s.sql("ROLLBACK")
        assert s.query("SELECT * FROM t").rows == [(1, 5)]
        s.cluster("t", "v")
        with pytest.raises(ExecError, match="duplicate key"):
            s.sql("INSERT INTO t VALUES (1, 7)")


def test_durability_levels(spark, tmp_path, monkeypatch):
    import os

    synced = []
    fsync = os.fsync
    monkeypatch.setattr(os, "fsync", lambda fd: (synced.append(os.readlink(f"/proc/self/fd/{fd}")), fsync(fd)))
    for level, at_commit, at_close in (("full", True, False), ("normal", False, True), ("off", False, False)):
        synced.clear()
        s = Session(spark, str(tmp_path / level), durability=level)
        s.script("CREATE TABLE t (id INT64); INSERT INTO t VALUES (1)")
        assert bool(synced) == at_commit
        if at_commit:
            assert any(x.endswith(".parquet") for x in synced) and any(x.endswith("/t_t") for x in synced) and any(x.endswith("/_manifest") for x in synced)
        synced.clear()
        s.close()
        assert bool(synced) == at_close


def test_keys_are_found_in_files_of_any_kind(spark, tmp_path):
    with Session(spark, str(tmp_path / "db")) as s:
        s.script("CREATE TABLE t (id INT64, v INT64); CREATE INDEX ON t (v); BEGIN; " + "; ".join(f"INSERT INTO t VALUES ({i}, {i})" for i in range(0, 100, 2)) + "; COMMIT; INSERT INTO t VALUES (51, 1)")
        stored = s.own["t"].stored
        folder = s.store.rewrite("t", stored, "id")
        from tessera.session import _changed

        for t in (stored, _changed(stored, files=[folder])):
            assert [s.store.has_key(t, k) for k in (-1, 0, 1, 50, 51, 53, 98, 99)] == [False, True, False, True, True, False, True, False]


def test_decimals_reach_the_files_as_integers(spark, tmp_path):
    values = [None, -(2**63), 2**63 - 1, -3, -2, 0, 1, 2, 3, 9007199254740993]
    spark.createDataFrame(list(enumerate(values)), "id long, x long").coalesce(1).write.parquet(str(tmp_path / "x"))
    s = Session(spark)
    s.register("v", str(tmp_path / "x"), key="id")
    for op, test in (("=", float.__eq__), ("<>", float.__ne__), ("<", float.__lt__), ("<=", float.__le__), (">", float.__gt__), (">=", float.__ge__)):
        for literal in ("2.0", "2.5", "-2.5", "-3.0", "0.0", "9007199254740992.0", "99999999999999999999.5"):
            sql = f"SELECT id FROM v WHERE x {op} {literal}"
            assert {r[0] for r in s.query(sql).rows} == {i for i, x in enumerate(values) if x is not None and test(float(x), float(literal))}, sql
    plan = s.sql("SELECT id FROM v WHERE x > 2.5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,2)" in plan


def test_ends_of_columns_come_from_footers(spark, sf):
    session = queries.shop(spark, sf, {"parts", "shop_orders"})
    df = session.sql("SELECT COUNT(*), MIN(id), MAX(id), MIN(size), MAX(size) FROM parts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(p_partkey)" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_ends_of_columns_that_footers_lack(spark, tmp_path):
    for rows in ([(1, None)], [(2, 7), (3, None)]):
        spark.createDataFrame(rows, "id long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    s = Session(spark)
    s.register("t", str(tmp_path / "x"), key="id")
    assert s.query("SELECT MIN(v), MAX(v), MIN(id), COUNT(*) FROM t").rows == [(7, 7, 1, 3)]
    assert s.index_bounds("t", "v") == (7, 7)


def test_switches_hold_for_their_own_plans(spark, sf):
    session = queries.shop(spark, sf, {"customers"})
    session.access_path = "scan"
    scanned = session.sql("SELECT name FROM customers WHERE id = 7")
    session.access_path = "auto"
    pushed = session.sql("SELECT name FROM customers WHERE id = 7")
    assert spark.conf.get("spark.sql.parquet.filterPushdown") == "true"
    assert [df.sparkSession.conf.get("spark.sql.parquet.filterPushdown") for df in (scanned, pushed)] == ["false", "true"]
    session.batch_rows = 0
    session.sql("SELECT id FROM customers")
    assert session.last_batch_rows() == 0
    session.batch_rows = 7
    assert len(session.query("SELECT id FROM customers").rows) == len(scanned.sparkSession.read.parquet(f"{sf}/customer.parquet").collect())
    assert session.last_batch_rows() == 7


def test_types_the_dialect_lacks_are_refused(spark):
    df = spark.sql("SELECT 1L AS id, CAST(1.5 AS DECIMAL(9, 2)) AS price, DATE'2020-01-01' AS day")
    s = Session(spark)
    with pytest.raises(ExecError, match=r"price \(decimal\(9,2\)\), day \(date\)"):
        s.register("t", df)
    s.register("t", df, partial=True)
    assert s.query("SELECT * FROM t").rows == [(1,)]


def test_rows_in_the_plan_text_come_from_one_run(spark, sf):
    session = queries.shop(spark, sf, {"customers", "shop_orders"})
    rows = session.query("SELECT c.city, COUNT(*) AS n FROM shop_orders o JOIN customers c ON o.customer = c.id WHERE o.day < 50 GROUP BY c.city").rows
    lines = session.explain_last().splitlines()
    assert lines[0].endswith(f"rows={len(rows)}")
    joined = session.query("SELECT COUNT(*) FROM shop_orders o JOIN customers c ON o.customer = c.id").rows[0][0]
    assert any("HashJoin ON o.customer = c.id" in x or "SortMergeJoin ON" in x for x in lines)
    assert any(x.rstrip().endswith(f"rows={sum(n for _, n in rows)}") for x in lines) and joined >= sum(n for _, n in rows)


def test_limits_beyond_32_bits(spark):
    s = Session(spark)
    s.register("t", spark.range(5).toDF("id"), key="id")
    assert len(s.query("SELECT id FROM t ORDER BY id LIMIT 5000000000").rows) == 5
    assert len(s.query("SELECT id FROM t LIMIT 9223372036854775807").rows) == 5


def test_indexes_serve_reads_of_changed_tables(spark, tmp_path, monkeypatch):
    from tessera import session
    from tessera.sources import store

    monkeypatch.setattr(session, "ROW_GROUP", 3)
    monkeypatch.setattr(session, "COMPACT_FILES", 3)
    with Session(spark, str(tmp_path / "db")) as s:
        s.script("CREATE TABLE t (id INT64, v INT64); BEGIN; " + "; ".join(f"INSERT INTO t VALUES ({i}, {-i})" for i in range(6)) + "; COMMIT; CREATE INDEX ON t (v)")
        for i in range(6, 14):
            copy = s.own["t"].stored.clustered["v"][0]
            files = s.sql("SELECT id FROM t WHERE v >= -3").inputFiles()
            assert any(copy in f for f in files)
            assert sorted(s.query("SELECT id FROM t WHERE v < -2").rows) == [(k,) for k in range(3, i)]
            s.sql(f"INSERT INTO t VALUES ({i}, {-i})")
        assert s.store.recovery.discarded == 0 and store.Store(spark, str(tmp_path / "db")).tables["t"].clustered["v"][0] == s.own["t"].stored.clustered["v"][0]


def test_index_join_sends_the_side_without_the_index(spark, sf):
    session = queries.shop(spark, sf, {"customers", "nations"})
    session.join_algorithm = "index_nested_loop"
    for sql, side in (("SELECT c.id FROM customers c JOIN nations n ON c.id = n.region", "BuildRight"), ("SELECT c.id FROM nations n JOIN customers c ON c.id = n.region", "BuildLeft")):
        assert side in session.sql(sql)._jdf.queryExecution().sparkPlan().toString()

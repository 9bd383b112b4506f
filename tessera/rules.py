"""The dialect's rules as registered queries: statements with the outcome each must have.

A query runs its statements in a new database and returns (step, outcome) rows;
an outcome is `ok`, the rows that came back (cells parted by |, rows by ;), or
the error's text. `.reopen` ends the session and opens the database again, as a
program would; other commands with a point ask the catalog. The oracle is the
table of outcomes written here.
"""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession

from .errors import SqlError
from .functions.types import Kind
from .plans.parser import parse
from .plans.render import render
from .session import Result, Session
from .shell import plain_cell, table_lines

_T = "CREATE TABLE t (id INT64 NOT NULL, a INT32, s TEXT, f BOOL)"
_FOUR = [(_T, "ok"), ("INSERT INTO t VALUES (4, 1, 'b', TRUE)", "ok"), ("INSERT INTO t VALUES (2, NULL, 'a', FALSE)", "ok"), ("INSERT INTO t VALUES (1, 5, NULL, TRUE)", "ok"), ("INSERT INTO t VALUES (3, 5, 'B', NULL)", "ok")]
_U = [("CREATE TABLE u (id INT64 NOT NULL, t_id INT64, w INT32)", "ok"), ("INSERT INTO u VALUES (10, 1, 7)", "ok"), ("INSERT INTO u VALUES (11, NULL, 8)", "ok"), ("INSERT INTO u VALUES (12, 1, 9)", "ok")]

# The dialect's error texts.
RULES: dict[str, list[tuple[str, str]]] = {
    "rule_names_and_case": [("CREATE TABLE Ab (Id INT64, id INT64)", "ok"), ("insert INTO Ab values (1, 2)", "ok"), ("Select id, Id From Ab", "2|1"), ("SELECT ID FROM Ab", "no such column: ID"), ("SELECT id FROM ab", "no such table: ab")],
    "rule_reserved_words": [("CREATE TABLE x (text INT64)", "expected a column name, found 'text'"), ("CREATE TABLE x (Limit INT64)", "expected a column name, found 'Limit'"), ("CREATE TABLE count (sum INT64)", "ok"), ("SELECT sum FROM count", "")],
    "rule_identifiers": [('CREATE TABLE "x" (id INT64)', "unexpected character '\"'"), ("CREATE TABLE _x1 (id INT64) -- note", "unexpected character '-'"), ("CREATE TABLE _x1 (id INT64)", "ok"), ("CREATE TABLE 1x (id INT64)", "expected a table name, found '1'")],
    "rule_numbers": [*_FOUR[:2], ("SELECT id FROM t WHERE id = - 4", "unexpected character '-'"), ("SELECT id FROM t WHERE id = 9223372036854775808", "integer literal out of range: 9223372036854775808"), ("SELECT id FROM t WHERE id > -9223372036854775808", "4"), ("SELECT id FROM t WHERE id < 4.5", "4")],
    "rule_strings": [_FOUR[0], ("INSERT INTO t VALUES (1, 1, 'it''s', TRUE)", "ok"), ("SELECT s FROM t WHERE s = 'it''s'", "it's"), ("SELECT s FROM t WHERE s = 'it", "unterminated string literal")],
    "rule_one_statement": [(_T + ";", "ok"), ("SELECT id FROM t; SELECT id FROM t", "expected the end of the statement, found 'SELECT'"), ("DROP TABLE t", "expected a statement (CREATE, INSERT, SELECT, BEGIN, COMMIT, or ROLLBACK)")],
    "rule_type_families": [*_FOUR, ("SELECT id FROM t WHERE s = 5", "type mismatch: s is TEXT, compared with 5"), ("SELECT id FROM t WHERE a = '5'", "type mismatch: a is INT32, compared with '5'"), ("SELECT id FROM t WHERE s = a", "cannot compare s (TEXT) with a (INT32)"), ("SELECT id FROM t WHERE f = 1", "type mismatch: f is BOOL, compared with 1"), ("SELECT id FROM t WHERE f = FALSE", "2"), ("SELECT id FROM t WHERE a >= id", "1;3")],
    "rule_decimals_as_doubles": [("CREATE TABLE v (id INT64, x INT64)", "ok"), ("INSERT INTO v VALUES (1, 9007199254740993)", "ok"), ("SELECT id FROM v WHERE x = 9007199254740992.0", "1"), ("SELECT id FROM v WHERE x = 9007199254740992", "")],
    "rule_null_comparisons": [*_FOUR, *_U, ("SELECT id FROM t WHERE a = NULL", ""), ("SELECT id FROM t WHERE a <> NULL", ""), ("SELECT id FROM t WHERE a <> 5", "4"), ("SELECT u.id FROM u JOIN u v ON u.t_id = v.t_id AND u.id < v.id", "10")],
    "rule_wide_literals": [*_FOUR, ("SELECT id FROM t WHERE a < 99999999999", "1;3;4"), ("SELECT id FROM t WHERE a = 3000000000", "")],
    "rule_order_of_nulls": [*_FOUR, ("SELECT id FROM t ORDER BY a", "4;1;3;2"), ("SELECT id FROM t ORDER BY a DESC", "2;1;3;4"), ("SELECT id FROM t ORDER BY f DESC, s LIMIT 2", "3;4")],
    "rule_order_of_rows": [*_FOUR, ("SELECT id FROM t", "1;2;3;4"), ("SELECT a, COUNT(*) FROM t GROUP BY a", "5|2;NULL|1;1|1"), ("SELECT id FROM t ORDER BY a LIMIT 2", "4;1")],
    "rule_grouped_columns": [*_FOUR, ("SELECT id, COUNT(*) FROM t GROUP BY a", "column id must appear in GROUP BY or be used in an aggregate"), ("SELECT a FROM t GROUP BY a ORDER BY s", "column s must appear in GROUP BY or be used in an aggregate"), ("SELECT s, COUNT(*) FROM t GROUP BY id", "column s must appear in GROUP BY or be used in an aggregate"), ("SELECT a FROM t GROUP BY a HAVING s = 'a'", "column s must appear in GROUP BY or be used in an aggregate")],
    "rule_aliases": [*_FOUR, ("SELECT a AS x FROM t GROUP BY x", "no such column: x"), ("SELECT a AS x FROM t GROUP BY a HAVING x > 1", "no such column: x"), ("SELECT a AS x FROM t GROUP BY a ORDER BY x DESC", "NULL;5;1")],
    "rule_star": [*_FOUR, ("SELECT * FROM t GROUP BY a", "SELECT * cannot be used with GROUP BY or aggregates; name the columns"), ("SELECT * FROM t WHERE id = 3", "3|5|B|NULL")],
    "rule_scope": [*_FOUR, *_U, ("SELECT id FROM t JOIN u ON t.id = u.t_id", "ambiguous column: id (qualify it with its table)"), ("SELECT w FROM t JOIN u ON t.id = u.t_id", "7;9"), ("SELECT t.id FROM t JOIN u ON t.id = v.id JOIN u v ON v.id = u.id", "no table named v is in scope for v.id"), ("SELECT t.id FROM t x", "no table named t is in scope for t.id"), ("SELECT * FROM t JOIN t ON id = id", "the name t refers to two tables; give one an alias"), ("SELECT id FROM t WHERE SUM(a) > 3", "aggregate functions are not allowed in WHERE or ON: SUM(a)")],
    "rule_insert_checks": [(_T, "ok"), ("CREATE TABLE k (id INT32)", "ok"), ("CREATE TABLE n (id INT64)", "ok"), ("INSERT INTO nope VALUES (1)", "no such table: nope"), ("INSERT INTO t VALUES (NULL, 'x')", "INSERT has 2 values but table t has 4 columns"), ("INSERT INTO t VALUES (1, 1.5, 'a', TRUE)", "type mismatch: column a expects INT32"), ("INSERT INTO t VALUES (1, 2147483648, 'a', TRUE)", "integer out of INT32 range for column a"), ("INSERT INTO t VALUES (1, 1, 5, TRUE)", "type mismatch: column s expects TEXT"), ("INSERT INTO t VALUES (1, 1, 'a', 1)", "type mismatch: column f expects BOOL"), ("INSERT INTO t VALUES (NULL, 1, 'a', TRUE)", "NULL in non-nullable column id"), ("INSERT INTO k VALUES (1)", "the key column (column 0) must be a non-null INT64"), ("INSERT INTO n VALUES (NULL)", "the key column (column 0) must be a non-null INT64"), ("INSERT INTO n VALUES (7)", "ok"), ("INSERT INTO n VALUES (7)", "duplicate key: n already has a row with id = 7"), ("SELECT id FROM n", "7")],
    "rule_sums": [("CREATE TABLE v (id INT64, x INT64, y INT32)", "ok"), ("INSERT INTO v VALUES (1, 9223372036854775807, 2147483647)", "ok"), ("INSERT INTO v VALUES (2, 1, 2147483647)", "ok"), ("SELECT SUM(y), AVG(y) FROM v", "4294967294|2147483647"), ("SELECT SUM(x) FROM v", "integer overflow in SUM"), ("SELECT AVG(x) FROM v", "integer overflow in AVG"), ("SELECT COUNT(*), SUM(x), AVG(x), MIN(x) FROM v WHERE id > 9", "0|NULL|NULL|NULL"), ("SELECT SUM(z) FROM v", "no such column: z")],
    "rule_aggregate_arguments": [*_FOUR[:2], ("SELECT SUM(s) FROM t", "SUM needs an integer column; s is TEXT"), ("SELECT AVG(f) FROM t", "AVG needs an integer column; f is BOOL"), ("SELECT SUM(*) FROM t", "only COUNT can take *"), ("SELECT MEDIAN(a) FROM t", "unknown function 'MEDIAN' (the aggregates are COUNT, SUM, AVG, MIN and MAX)")],
    "rule_errors_end_transactions": [("CREATE TABLE n (id INT64)", "ok"), ("BEGIN", "ok"), ("INSERT INTO n VALUES (1)", "ok"), ("CREATE TABLE gone (id INT64)", "ok"), ("INSERT INTO n VALUES (1)", "duplicate key: n already has a row with id = 1"), ("SELECT COUNT(*) FROM n", "0"), ("SELECT id FROM gone", "no such table: gone"), ("COMMIT", "COMMIT without BEGIN")],
    "rule_errors_that_do_not": [("CREATE TABLE n (id INT64)", "ok"), ("BEGIN", "ok"), ("INSERT INTO n VALUES (1)", "ok"), ("BEGIN", "BEGIN inside a transaction"), ("SELEC", "expected a statement (CREATE, INSERT, SELECT, BEGIN, COMMIT, or ROLLBACK)"), ("COMMIT", "ok"), ("SELECT id FROM n", "1"), ("ROLLBACK", "ROLLBACK without BEGIN")],
    "rule_sessions_end": [("CREATE TABLE n (id INT64, v INT64)", "ok"), ("INSERT INTO n VALUES (1, 2)", "ok"), ("BEGIN", "ok"), ("INSERT INTO n VALUES (3, 4)", "ok"), ("CREATE INDEX ON n (v)", "ok"), ("SELECT COUNT(*) FROM n", "2"), (".reopen", "rolled back"), ("SELECT id, v FROM n", "1|2"), ("CREATE INDEX ON n (v)", "ok"), (".reopen", "ok"), (".tables", "n: 1 rows, index on v"), ("CREATE INDEX ON n (v)", "column n.v already has an index"), ("CREATE INDEX ON n (id)", "column id is the key of n; the table's own B+Tree is already its index"), ("CREATE TABLE n (id INT64)", "table already exists: n")],
    "rule_limits": [("CREATE TABLE n (id INT64, s TEXT)", "ok"), ("INSERT INTO n VALUES (1, '" + "x" * 5000 + "')", "record too large for a page"), ("CREATE TABLE w (" + ", ".join(f"c{i} INT64" for i in range(9)) + ")", "too many columns for the catalog"), ("SELECT id FROM n LIMIT 0", ""), ("SELECT id FROM n LIMIT -1", "LIMIT must not be negative"), ("SELECT n.id FROM n " + " ".join(f"JOIN n n{i} ON n{i}.id = n.id" for i in range(64)), "a query may join at most 64 tables")],
    "rule_catalog_questions": [*_FOUR, ("CREATE INDEX ON t (a)", "ok"), (".bounds t a", "1|5"), (".bounds t id", "1|4"), (".count t a 2 9 10", "2"), (".count t id 1 4 3", "3"), (".scan t", "1|5|NULL|t;2|NULL|a|f;3|5|B|NULL;4|1|b|t"), (".tables", "t: 4 rows, index on a")],
    "rule_switches": [*_FOUR, *_U, *((f".{switch} SELECT t.id, u.w FROM t JOIN u ON u.t_id = t.id WHERE u.w > 7", "1|9") for switch in ("access_path=scan", "access_path=index", "literal_planning=True", "batch_rows=0", "batch_rows=2", "join_algorithm=hash", "join_algorithm=hash_left", "join_algorithm=nested_loop", "join_algorithm=index_nested_loop")), (".join_algorithm=hash SELECT t.id FROM t JOIN u ON u.t_id < t.id", "a hash join needs an ON equality between a column of each table: u.t_id < t.id"), (".join_algorithm=index_nested_loop SELECT t.id FROM t JOIN u ON u.w = t.a", "no index to search for an index nested-loop join: u.w = t.a")],
    "rule_plan_text": [*_FOUR, ("SELECT a, COUNT(*) AS n FROM t WHERE id > 1 GROUP BY a HAVING COUNT(*) > 0 ORDER BY n DESC LIMIT 2", "NULL|1;5|1"), (".explain", "Project a, COUNT(*) AS n rows=2;Sort n DESC (top 2) rows=2;Filter COUNT(*) > 0 rows=3;HashAggregate GROUP BY a: COUNT(*) rows=3;Filter id > 1 rows=3;SeqScan t rows=4 est=4")],
    "rule_unparse": [(".render select a as b,count(*)from t x join u on x.id=u.id where s<>'it''s' group by a order by b desc limit 3", "SELECT a AS b, COUNT(*) FROM t x JOIN u ON x.id = u.id WHERE s <> 'it''s' GROUP BY a ORDER BY b DESC LIMIT 3")],
    "rule_table_printer": [*_FOUR, ("SELECT id, s, f FROM t WHERE id <= 2", "1|NULL|t;2|a|f"), (".print", "id  s         f;--  ----  -----; 1  NULL   TRUE; 2  a     FALSE")],
    "rule_error_places": [(".where SELECT a FROM t WHERE a @ 3", "parse error at line 1, column 25: unexpected character '@';    SELECT a FROM t WHERE a @ 3;                            ^"), (".where SELECT a b FROM t", "parse error at line 1, column 10: expected FROM, found 'b';    SELECT a b FROM t;             ^")],
    "rule_row_sources": [(".register", "ok"), ("SELECT v, COUNT(*) FROM mem GROUP BY v", "x|2;NULL|1"), ("INSERT INTO mem VALUES (4, 'y')", "table mem is registered from outside and cannot be changed")],
}


class _Run:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.session = Session(spark, path, deterministic=True)
        self.last: Result | None = None

    def _rows(self, sql: str) -> str:
        r = self.session.query(sql)
        if not r.columns:
            return "ok"
        self.last = r
        return _cells(r.rows, r.kinds)

    def outcome(self, statement: str) -> str:
        try:
            return self._command(statement) if statement.startswith(".") else self._rows(statement)
        except SqlError as e:
            return e.message

    def _command(self, text: str) -> str:
        word, _, rest = text[1:].partition(" ")
        s = self.session
        if "=" in word:
            name, value = word.split("=")
            before = getattr(s, name)
            setattr(s, name, int(value) if value.isdigit() else value == "True" if value in ("True", "False") else value)
            try:
                return self._rows(rest)
            finally:
                setattr(s, name, before)
        args = shlex.split(rest) if word in ("bounds", "count", "scan") else []
        if word == "reopen":
            open_ = s.close()
            self.session = Session(self.spark, self.path, deterministic=True)
            return "rolled back" if open_ else "ok"
        if word == "tables":
            return ";".join(f"{n}: {s.row_count(n)} rows" + "".join(f", index on {c}" for c in s.indexed(n)) for n in s.table_names())
        if word == "bounds":
            return "|".join(map(str, s.index_bounds(*args)))
        if word == "count":
            return str(s.count_index(args[0], args[1], *map(int, args[2:])))
        if word == "scan":
            rows: list[tuple] = []
            s.scan_table(args[0], rows.append)
            return _cells(rows, [c.kind for c in s.columns_of(args[0])])
        if word == "explain":
            lines = s.explain_last(estimates=True).splitlines()
            return ";".join(" ".join(x.split()) for x in lines if "rows=" in x)
        if word == "render":
            return render(parse(rest))
        if word == "print":
            return ";".join(table_lines(self.last))
        if word == "where":
            try:
                parse(rest)
            except SqlError as e:
                return e.render(rest).replace("\n", ";")
        if word == "register":
            s.register("mem", self.spark.createDataFrame([(1, "x"), (2, None), (3, "x")], "id long, v string"), key="id")
        return "ok"


def _cells(rows: list[tuple], kinds: list[Kind]) -> str:
    return ";".join("|".join(plain_cell(v, k) for v, k in zip(row, kinds, strict=True)) for row in rows)


def run(spark: SparkSession, path: str, steps: list[tuple[str, str]]) -> DataFrame:
    program = _Run(spark, path)
    rows = [(i, program.outcome(statement)) for i, (statement, _) in enumerate(steps)]
    program.session.close()
    return spark.createDataFrame(rows, "step int, outcome string")


def oracle(steps: list[tuple[str, str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"(CAST({i} AS INTEGER), {quoted(expected)})" for i, (_, expected) in enumerate(steps))
    return f"SELECT * FROM (VALUES {values}) v(step, outcome)"

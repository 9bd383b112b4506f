from __future__ import annotations

import io
import re

from tessera.functions.types import Kind
from tessera.session import Result, Session
from tessera.shell import Shell, main, split, table_lines

SCRIPT = """CREATE TABLE ships (no INT64 NOT NULL, port TEXT, afloat BOOL);
CREATE TABLE calls (no INT64 NOT NULL, ship INT64, tons INT32);
INSERT INTO ships VALUES (7, 'Cadiz', TRUE); INSERT INTO ships VALUES (3, NULL, FALSE);
INSERT INTO calls VALUES (1, 7, 40);
INSERT INTO calls VALUES (2, 7, 60); INSERT INTO calls
  VALUES (3, 5, NULL);
CREATE INDEX ON calls (ship);
SELECT * FROM ships;
SELECT SUM(tonnes) FROM calls;
INSERT INTO ships VALUES (7, 'Faro', TRUE);
SELECT port FROM ships WHERE no = 3 OR no = 7;
SELECT s.port, AVG(c.tons) AS mean FROM calls c JOIN ships s ON c.ship = s.no GROUP BY s.port;
.explain
.tables
.tabels
"""
OUT = """no  port   afloat
--  -----  ------
 3  NULL    FALSE
 7  Cadiz    TRUE
(2 rows)

s.port  mean
------  ----
Cadiz     50
(1 row)

Project s.port, AVG(c.tons) AS mean                         rows=1
  Sort                                                      rows=1
    HashAggregate GROUP BY s.port: AVG(c.tons)              rows=1
      JOIN ON c.ship = s.no                                 rows=2
        SeqScan calls AS c                                  rows=3 est=3
        SeqScan ships AS s                                  rows=2 est=2
ships: 2 rows
calls: 3 rows, index on ship
"""
ERR = """error: no such column: tonnes
error: duplicate key: ships already has a row with no = 7
error: parse error at line 1, column 37: expected the end of the statement, found 'OR'
    SELECT port FROM ships WHERE no = 3 OR no = 7
                                        ^
unknown command: .tabels
"""


def test_session(spark, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    code = Shell(Session(spark, str(tmp_path / "db"), deterministic=True), out=out, err=err).read(io.StringIO(SCRIPT))
    shown = "\n".join(x for x in out.getvalue().split("\n") if not x.lstrip().startswith("read with"))
    shown = re.sub("(BroadcastHash|SortMerge|ShuffledHash)Join ON", "JOIN ON", shown)
    squeeze = lambda text: [" ".join(x.split()) if "rows=" in x else x for x in text.split("\n")]
    assert (squeeze(shown), err.getvalue(), code) == (squeeze(OUT), ERR, 1)


def test_plain_and_command(spark, tmp_path, capsys):
    db = str(tmp_path / "db")
    sql = "CREATE TABLE t (id INT64, f BOOL, s TEXT); INSERT INTO t VALUES (1, TRUE, 'a;b'); INSERT INTO t VALUES (2, NULL, 'it''s'); SELECT * FROM t; SELECT AVG(id) FROM t"
    assert main(["--plain", "--durability", "off", db, "-c", sql], spark) == 0
    assert capsys.readouterr().out == "1|t|a;b\n2|NULL|it's\n1.5\n"
    assert main([db, "-c", "SELECT AVG(id) FROM t"], spark) == 0
    told = capsys.readouterr()
    assert "      2\n" in told.out and told.err.startswith("recovered: ")


def test_usage(spark, capsys):
    assert main([], spark) == 2
    assert main(["--durability", "half", "x"], spark) == 2
    assert "usage" in capsys.readouterr().err


def test_split():
    assert split("a; b 'x;''y' ;c") == (["a", " b 'x;''y' "], "c")


def test_table_alignment():
    r = Result(["n", "avg", "f", "none"], [Kind.INT64, Kind.DOUBLE, Kind.BOOL, Kind.INT64], [(1, 2.25, True, None), (20, None, False, None)])
    assert table_lines(r, 2) == [" n   avg      f  none", "--  ----  -----  ----", " 1  2.25   TRUE  NULL", "20  NULL  FALSE  NULL"]
    assert table_lines(r)[2] == " 1     2   TRUE  NULL"

"""A session: statements in, DataFrames or effects out, with transactions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import explain
from .errors import ExecError, LimitError, SqlError
from .functions.types import Column, Kind, Literal
from .operators.lower import Source, PlanStep, lower
from .operators.relations import JOIN_ALGORITHMS
from .plans.binder import BoundSelect, bind
from .plans.nodes import CreateIndex, CreateTable, Insert, Select, Statement, Transaction
from .plans.parser import parse, parse_script
from .sources.store import COMPACT_FILES, ROW_GROUP, Store, Stored
from .sources.tables import MAX_RECORD, Table, check_limits, external


#: Settings under which MIN, MAX and COUNT(*) of whole Parquet tables come from the files' footers.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
_FOOTER_SWITCH = ("spark.sql.parquet.aggregatePushdown", "false")
#: Optimizer rules that place terms elsewhere than written.
_PLACEMENT = ",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in ("PushDownPredicates", "PushPredicateThroughNonJoin", "PushPredicateThroughJoin", "InferFiltersFromConstraints", "ReorderJoin"))


@dataclass
class Result:
    """Column headings and rows; both empty for statements that return none."""

    columns: list[str]
    kinds: list[Kind]
    rows: list[tuple]


@dataclass
class Pending:
    """An own table inside the running transaction: the stored part, and rows not yet written."""

    stored: Stored
    rows: list[tuple]


class Session:
    """deterministic: bare rows in key order, groups in order of first appearance.

    The switches change plans, never answers: join_algorithm (see JOIN_ALGORITHMS);
    access_path "auto", "scan" (no filter pushdown into files) or "index";
    literal_planning (terms stay where they are written); batch_rows (None: Spark's
    own; 0: a row at a time; n: rows of a columnar batch). They hold for the plans
    made while they are set, whenever those run, and for no others: such plans
    belong to a Spark session of their own. Tables registered as DataFrames keep
    the session they came from.

    Without a path, committed rows live in the driver as long as the session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, durability: str = "full", deterministic: bool = False, strict_limits: bool = True):
        self.spark, self.deterministic, self.strict_limits = spark, deterministic, strict_limits
        spark.conf.set("spark.sql.ansi.enabled", "true")
        self.store = Store(spark, path, durability) if path else None
        self.external: dict[str, Table] = {}
        self.own: dict[str, Pending] = {n: Pending(t, []) for n, t in self.store.tables.items()} if self.store else {}
        #: Without a store: the committed tables, and how many of their rows.
        self.committed: dict[str, tuple[Stored, list[tuple]]] = {}
        #: Keys of rows not yet written.
        self.keys: dict[str, set[int]] = {}
        self.in_transaction = False
        self.join_algorithm = "auto"
        self.access_path = "auto"
        self.literal_planning = False
        self.batch_rows: int | None = None
        self._sessions: dict[tuple, SparkSession] = {}
        self.last_plan: PlanStep | None = None
        self.last_select: Select | None = None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> bool:
        """Rolls back an open transaction; tells whether there was one."""
        open_ = self.in_transaction
        if open_:
            self._rollback()
        if self.store is not None:
            self.store.settle()
        return open_

    # Tables.

    def register(self, name: str, df: DataFrame | str, key: str | None = None, renames: dict[str, str] | None = None, columns: list[str] | None = None, partial: bool = False) -> None:
        """Makes a DataFrame, or the Parquet files at a path, a read-only table.

        columns: SQL expressions to select first. Columns of types the dialect
        lacks are refused, or left out if `partial`.
        """
        schema = _schema(self.spark, df) if isinstance(df, str) else None

        def frame(spark: SparkSession) -> DataFrame:
            found = spark.read.schema(schema).parquet(df) if schema is not None else df
            return (found.selectExpr(*columns) if columns else found).withColumnsRenamed(renames or {})

        self.external[name] = external(name, frame, frame(self.spark).schema, key, partial)

    def table_names(self) -> list[str]:
        return [*self.own, *self.external]

    def columns_of(self, name: str) -> list[Column] | None:
        if name in self.own:
            return self.own[name].stored.columns
        return self.external[name].columns if name in self.external else None

    def row_count(self, name: str) -> int | None:
        return self.own[name].stored.rows + len(self.own[name].rows) if name in self.own else self.external[name].rows

    def indexed(self, name: str) -> list[str]:
        """Indexed columns in the table's order."""
        have = self.own[name].stored.indexed if name in self.own else self.external[name].indexed
        return [c.name for c in self.columns_of(name) if c.name in have]

    def _source(self, name: str, wanted: str | None = None, spark: SparkSession | None = None) -> Source:
        spark = spark or self.spark
        if name in self.external:
            t = self.external[name]
            return Source(t.frame(spark), t.rows, t.key, frozenset(t.indexed))
        pending = self.own[name]
        stored = pending.stored
        df = self.store.frame(name, stored, wanted, spark) if self.store else spark.createDataFrame([], stored.schema())
        if pending.rows:
            df = df.unionByName(spark.createDataFrame(pending.rows, stored.schema()))
        return Source(df, self.row_count(name), stored.columns[0].name, frozenset(stored.indexed))

    # Statements.

    def sql(self, text: str) -> DataFrame | None:
        """Runs one statement; a SELECT returns its lazy DataFrame."""
        return self.run(parse(text))

    def script(self, text: str) -> list[DataFrame | None]:
        return [self.run(s) for s in parse_script(text)]

    def run(self, statement: Statement) -> DataFrame | None:
        if isinstance(statement, Transaction):
            return self._bounds(statement.action)
        try:
            match statement:
                case Select():
                    return self._select(statement)
                case CreateTable():
                    self._create(statement)
                case CreateIndex():
                    self._index(statement)
                case Insert():
                    self._insert(statement)
            if not self.in_transaction:
                self._commit()
            return None
        except Exception:
            # Any error while running ends the transaction, and nothing of it stays.
            if self.store is not None:
                self.store.reload()
            self._rollback()
            raise

    def query(self, text: str) -> Result:
        """Runs one statement and collects its rows, with the dialect's own run-time errors."""
        statement = parse(text)
        df = self.run(statement)
        if df is None:
            return Result([], [], [])
        return self.collect(df, statement)

    def collect(self, df: DataFrame, statement: Select) -> Result:
        try:
            rows: list[Row] = df.collect()
        except Exception as e:
            self._rollback()
            raise overflow(e, statement) or e from None
        return Result(df.columns, [k for _, k in self.last_output], [tuple(r) for r in rows])

    def _bounds(self, action: str) -> None:
        if action == "BEGIN":
            if self.in_transaction:
                raise ExecError("BEGIN inside a transaction")
            self.in_transaction = True
        elif not self.in_transaction:
            raise ExecError(f"{action} without BEGIN")
        elif action == "COMMIT":
            self.in_transaction = False
            try:
                self._commit()
            except Exception:
                # Nothing of the transaction stays; another session's commit shows from now on.
                if self.store is not None:
                    self.store.reload()
                self._rollback()
                raise
        else:
            self._rollback()

    # SELECT.

    def plan(self, statement: Select, watch=None, footers: bool = False) -> PlanStep:
        """The statement lowered; watch(DataFrame) stands in for each step's rows, if given; footers: answered from them, if it asks for nothing else."""
        if self.join_algorithm not in JOIN_ALGORITHMS:
            raise ValueError(f"join_algorithm is one of {', '.join(JOIN_ALGORITHMS)}")
        bound = bind(statement, self.columns_of)
        wanted = {}
        if self.access_path != "scan" and not self.deterministic:
            for t in bound.where:
                if isinstance(t.right, Literal) and t.op != "<>":
                    wanted.setdefault(t.left.label, t.left.column.name)
        by_name = {ref.name: wanted.get(ref.label) for ref, _ in bound.tables}
        self.last_output = [(h, c.column.kind) for c, h in bound.output]
        settings = self._settings(bound)
        if watch or not footers:
            settings = {k: v for k, v in settings.items() if k not in _FOOTERS}
        spark = self._spark(settings)
        return lower(statement, bound, lambda name: self._source(name, by_name[name], spark), self.join_algorithm, self.deterministic, watch)

    def _select(self, statement: Select) -> DataFrame:
        self.last_plan, self.last_select = self.plan(statement, footers=True), statement
        if self.last_plan.df.sparkSession.conf.get(*_FOOTER_SWITCH) == "true":
            try:
                self.last_plan.df.collect()  # one row, from footers alone; Spark fails where a file lacks the ends of a column
            except Exception:
                self.last_plan = self.plan(statement)
        return self.last_plan.df

    def _settings(self, bound: BoundSelect) -> dict[str, str]:
        """What the switches and the statement ask of Spark."""
        wanted: dict[str, str] = {}
        if self.access_path == "scan":
            wanted["spark.sql.parquet.filterPushdown"] = "false"
        elif bound.groups == [] and len(bound.tables) == 1 and not bound.where and {a.func for a in bound.aggregates} <= {"MIN", "MAX", "COUNT"}:
            wanted |= _FOOTERS
        if self.literal_planning:
            wanted["spark.sql.optimizer.excludedRules"] = _PLACEMENT
        if self.batch_rows == 0:
            wanted |= {"spark.sql.codegen.wholeStage": "false", "spark.sql.parquet.enableVectorizedReader": "false"}
        elif self.batch_rows:
            wanted["spark.sql.parquet.columnarReaderBatchSize"] = str(self.batch_rows)
        return wanted

    def last_batch_rows(self) -> int:
        """Rows of a batch in the last plan: 0 if it ran a row at a time."""
        if self.last_plan is None:
            return 0
        conf = self.last_plan.df.sparkSession.conf
        return int(conf.get("spark.sql.parquet.columnarReaderBatchSize")) if conf.get("spark.sql.parquet.enableVectorizedReader") == "true" else 0

    def _spark(self, settings: dict[str, str]) -> SparkSession:
        """The caller's session, or one with its settings and these."""
        if not settings:
            return self.spark
        given = self.spark.conf.getAll
        key = (frozenset(settings.items()), frozenset(given.items()))
        if key not in self._sessions:
            own = self.spark.newSession()
            for k, v in given.items():
                if own.conf.get(k, None) != v and own.conf.isModifiable(k):
                    own.conf.set(k, v)
            for k, v in settings.items():
                own.conf.set(k, v)
            self._sessions[key] = own
        return self._sessions[key]

    # The catalog's own questions.

    def scan_table(self, name: str, visit) -> None:
        """Calls visit(row) for every row, in key order, a partition at a time."""
        source = self._source(name)
        df = source.df.orderBy(self._stored(source.df, name, source.key)) if source.key else source.df
        for row in df.toLocalIterator():
            visit(tuple(row))

    def index_bounds(self, name: str, column: str) -> tuple | None:
        """Smallest and largest value of a column, None if it has none; from file statistics where Spark pushes it down."""
        for spark in (self._spark(_FOOTERS), self.spark):
            df = self._source(name, spark=spark).df
            at = self._stored(df, name, column)
            try:
                low, high = df.agg(F.min(at), F.max(at)).first()
                break
            except Exception:  # a file whose footer lacks the ends of the column
                if spark is self.spark:
                    raise
        return None if low is None else (low, high)

    def count_index(self, name: str, column: str, low, high, most: int) -> int:
        """Rows with low <= column <= high, counted no further than `most`."""
        df = self._source(name).df
        return df.filter(self._stored(df, name, column).between(low, high)).limit(most).count()

    def _stored(self, df: DataFrame, name: str, column: str):
        """A column of the table's rows, by its place."""
        return F.col(f"`{df.columns[[c.name for c in self.columns_of(name)].index(column)]}`")

    def explain_last(self, estimates: bool = False, physical: bool = False) -> str:
        """The last SELECT's steps with the rows each produced, counted in one run of the plan."""
        return explain.text(self.last_select and explain.watched(self.plan, self.last_select), estimates, physical)

    # Definition and change.

    def _create(self, s: CreateTable) -> None:
        if self.columns_of(s.table) is not None:
            raise ExecError(f"table already exists: {s.table}")
        if self.strict_limits:
            check_limits(s.table, list(s.columns), len(self.own))
        self.own[s.table] = Pending(Stored(list(s.columns)), [])
        self.keys[s.table] = set()

    def _index(self, s: CreateIndex) -> None:
        columns = self.columns_of(s.table)
        if columns is None:
            raise ExecError(f"no such table: {s.table}")
        names = [c.name for c in columns]
        if s.column not in names:
            raise ExecError(f"no such column: {s.table}.{s.column}")
        if names.index(s.column) == 0:
            raise ExecError(f"column {s.column} is the key of {s.table}; the table's own B+Tree is already its index")
        if s.table in self.external:
            have = self.external[s.table].indexed
            if s.column in have:
                raise ExecError(f"column {s.table}.{s.column} already has an index")
            have.add(s.column)  # answers never depend on an index; an external table's files stay as they are
            return
        stored = self.own[s.table].stored
        if s.column in stored.indexed:
            raise ExecError(f"column {s.table}.{s.column} already has an index")
        stored = _changed(stored, indexed=[*stored.indexed, s.column])
        if self.store is not None and not self.in_transaction and stored.rows > ROW_GROUP:
            stored = self._clustered(s.table, stored, s.column)
        self.own[s.table].stored = stored

    def _insert(self, s: Insert) -> None:
        columns = self.columns_of(s.table)
        if columns is None:
            raise ExecError(f"no such table: {s.table}")
        if s.table in self.external:
            raise ExecError(f"table {s.table} is registered from outside and cannot be changed")
        if len(s.values) != len(columns):
            raise ExecError(f"INSERT has {len(s.values)} values but table {s.table} has {len(columns)} columns")
        row = tuple(coerce(v, c) for v, c in zip(s.values, columns, strict=True))
        if row[0] is None or columns[0].kind is not Kind.INT64:
            raise ExecError("the key column (column 0) must be a non-null INT64")
        if self.strict_limits and _record_bytes(row, columns) > MAX_RECORD:
            raise LimitError("record too large for a page")
        if self._has_key(s.table, row[0]):
            raise ExecError(f"duplicate key: {s.table} already has a row with {columns[0].name} = {row[0]}")
        self.keys[s.table].add(row[0])
        self.own[s.table].rows.append(row)

    def _has_key(self, name: str, key: int) -> bool:
        """Rows not yet written are known by key; of files, only row groups whose key range holds the key are read."""
        if name not in self.keys:
            self.keys[name] = {r[0] for r in self.own[name].rows}
        if key in self.keys[name]:
            return True
        return self.store is not None and self.store.has_key(self.own[name].stored, key)

    def _commit(self) -> None:
        if self.store is None:
            self.committed = {n: (p.stored, list(p.rows)) for n, p in self.own.items()}
            return
        before = self.store.tables
        if all(not p.rows and before.get(n) is p.stored for n, p in self.own.items()):
            return
        after: dict[str, Stored] = {}
        for name, p in self.own.items():
            stored = p.stored
            if p.rows:
                files = list(stored.files)
                if len(files) >= COMPACT_FILES:  # many small commits become one folder, in the executors
                    files = [self.store.rewrite(name, stored, stored.columns[0].name)]
                files.append(self.store.write(name, stored, p.rows, stored.columns[0].name))
                compacted = files[:1] if len(stored.files) >= COMPACT_FILES else []
                stored = _changed(stored, files=files, rows=stored.rows + len(p.rows), clustered={} if compacted else stored.clustered)
                if compacted and stored.rows > ROW_GROUP:  # the indexes' copies are made anew with the table
                    whole = _changed(stored, files=compacted)
                    stored = _changed(stored, clustered={c: [self.store.rewrite(name, whole, c), *compacted] for c in stored.indexed})
            after[name] = stored
        self.store.commit(after)
        self.own = {n: Pending(t, []) for n, t in after.items()}
        self.keys.clear()

    def cluster(self, name: str, column: str) -> None:
        """Writes a copy of an own table clustered by an indexed column, whose row groups prune range scans.

        Larger tables get one by CREATE INDEX and whenever their files are rewritten
        as one; rows committed since are read beside it.
        """
        if self.in_transaction or self.store is None:
            raise ExecError("a table can be clustered only in a stored database, outside a transaction")
        stored = self.own[name].stored
        if column not in stored.indexed:
            raise ExecError(f"column {name}.{column} has no index")
        self.own[name].stored = self._clustered(name, stored, column)
        self._commit()

    def _clustered(self, name: str, stored: Stored, column: str) -> Stored:
        return _changed(stored, clustered={**stored.clustered, column: [self.store.rewrite(name, stored, column), *stored.files]})

    def _rollback(self) -> None:
        self.in_transaction = False
        if self.store is not None:
            self.own = {n: Pending(t, []) for n, t in self.store.tables.items()}
        else:
            self.own = {n: Pending(stored, list(rows)) for n, (stored, rows) in self.committed.items()}
        self.keys.clear()


_schemas: dict[tuple[str, str], T.StructType] = {}


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema of Parquet files, read once in an application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return _schemas[key]


def _changed(stored: Stored, **values) -> Stored:
    return Stored(**{"columns": stored.columns, "files": stored.files, "rows": stored.rows, "indexed": stored.indexed, "clustered": stored.clustered} | values)


def coerce(value: Literal, column: Column):
    """The literal as the column stores it; no implicit casts but INT32's narrower range."""
    if value.is_null:
        if not column.nullable:
            raise ExecError(f"NULL in non-nullable column {column.name}")
        return None
    expected = Kind.INT64 if column.kind is Kind.INT32 else column.kind
    if value.kind is not expected:
        raise ExecError(f"type mismatch: column {column.name} expects {column.kind.value}")
    if column.kind is Kind.INT32 and not -(1 << 31) <= value.value < 1 << 31:
        raise ExecError(f"integer out of INT32 range for column {column.name}")
    return value.value


def _record_bytes(row: tuple, columns: list[Column]) -> int:
    fixed = {Kind.INT64: 8, Kind.INT32: 4, Kind.BOOL: 1, Kind.TEXT: 4}
    return (len(columns) + 7) // 8 + sum(fixed[c.kind] + (len(v.encode()) if c.kind is Kind.TEXT and v is not None else 0) for v, c in zip(row, columns, strict=True))


def overflow(error: Exception, statement: Select) -> SqlError | None:
    """Spark's arithmetic overflow as the dialect words it, by the function that was asked for."""
    if not re.search(r"ARITHMETIC_OVERFLOW|long overflow", str(error)):
        return None
    values = [i.value for i in statement.items] + [c.left for c in statement.having] + [o.value for o in statement.order_by]
    asked = [v.func for v in values if v.func in ("SUM", "AVG")]
    return ExecError(f"integer overflow in {asked[0] if asked else 'SUM'}")

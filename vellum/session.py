"""Engines, sessions and transactions over a versioned store.

A transaction sees a pinned version with its journal, plus its own edits. Every statement computes its edits as a plan,
checks them, writes them as Parquet and only then belongs to the transaction, so a failed statement undoes itself. Commit
takes the store's lock, compares keys and unique values with what was committed since, and adds one entry.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog import Check, Schema
from vellum.functions import dialect
from vellum.functions.dialect import DialectError
from vellum.operators import constraints, ddl, dml, merge, overlay
from vellum.plans import router
from vellum.plans.router import Statement
from vellum.sources.store import ConflictError, Store, copy_file, copy_files

MODES = ("journal", "audit")
#: Bytes of a base file; transactions whose order is written in the plan (of more it is joined); files that tasks copy.
FILE_BYTES, LITERAL_ORDER, DISTRIBUTED_COPIES = 128 << 20, 100, 64
#: Types of a first key column whose range is kept for each file: their text says all, and compares as the column does.
PRUNED = frozenset("tinyint smallint mediumint int bigint date".split())
#: Rows where their number is not known: of edits in journal entries that do not say it.
UNKNOWN = 1 << 60
_STATEMENT_META = "`_op` string, `_seq` bigint, `_tx` string"


class ConstraintError(ValueError):
    """Rows that a key, NOT NULL, UNIQUE or CHECK forbids."""


class TransactionError(RuntimeError):
    """A statement that the transaction's state does not allow."""


@dataclass(frozen=True)
class TableState:
    """What a table is at some point: schema, base files, and change files with their order."""

    name: str
    schema: Schema
    files: tuple[dict, ...] = ()
    changes: tuple[str, ...] = ()
    order: tuple[tuple[str, int], ...] = ()  # transaction, generation
    edits: int = 0  # rows in changes, at most

    @property
    def most(self) -> int:
        """Rows at most; nothing is read to tell."""
        return sum(f["rows"] for f in self.files) + self.edits


@dataclass
class Snapshot:
    version: str
    generation: int
    tables: dict[str, TableState]


def snapshot(store: Store, version: str | None = None, journal: bool = True) -> Snapshot:
    """The state at a version; with its journal if it is the head."""
    while True:
        head = store.version(version) if version else store.head()
        entries = store.journal(head.id) if journal else []
        if version or store.ref("data") == head.id:  # else its journal may be gone already
            break
    tables = {k: TableState(t["name"], Schema.from_json(t["schema"]), tuple(t["files"])) for k, t in head.tables.items()}
    generation = 0
    for e in entries:
        generation = e["generation"]
        for k, t in e["tables"].items():
            if t.get("dropped"):
                tables.pop(k, None)
                continue
            if "files" in t:  # a new form or a new table
                tables[k] = TableState(t["name"], Schema.from_json(t["schema"]), tuple(t["files"]))
            if t.get("changes"):
                now = tables[k]
                tables[k] = replace(now, changes=(*now.changes, *t["changes"]), order=(*now.order, (e["tx"], generation)), edits=now.edits + t.get("edits", UNKNOWN))
    return Snapshot(head.id, generation, tables)


@dataclass
class Transaction:
    base: Snapshot
    tables: dict[str, TableState]
    read_only: bool = False
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    statements: int = 0
    changes: dict[str, list[str]] = field(default_factory=dict)  # table -> change files of this transaction
    edits: dict[str, int] = field(default_factory=dict)  # table -> rows in them, at most
    formed: dict[str, dict] = field(default_factory=dict)  # table -> new form or dropped


@dataclass
class Work:
    """What an engine and its sessions have done; all numbers are counted on the driver, none costs a job."""

    queries: int = 0
    statements: int = 0
    rows_changed: int = 0
    commits: int = 0
    conflicts: int = 0
    rollbacks: int = 0
    checkpoints: int = 0
    files_read: int = 0
    files_pruned: int = 0
    files_written: int = 0
    files_kept: int = 0

    def since(self, before: Work) -> Work:
        return Work(**{f.name: getattr(self, f.name) - getattr(before, f.name) for f in fields(self)})

    def copy(self) -> Work:
        return replace(self)


class Engine:
    """A store, a Spark session and a mode: journal (edits since a version) or audit (a version a transaction)."""

    def __init__(self, store: Store, spark: SparkSession, mode: str = "journal"):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.store, self.spark, self.mode, self.closed = store, spark, mode, False
        self.work = Work()
        store.copier = self._copy

    def _copy(self, pairs: list[tuple[str, str]]) -> None:
        """Copies files by tasks, where there are many; the folders must be mounted by all executors."""
        if len(pairs) < DISTRIBUTED_COPIES:
            copy_files(pairs)
        else:
            self.spark.createDataFrame(pairs, "a string, b string").repartition(min(len(pairs), 1000)).mapInPandas(_copied, "n bigint").count()

    def session(self) -> Session:
        return Session(self)

    def close(self) -> None:
        self.closed = True

    def recover_commit(self, transaction: str) -> str:
        return self.store.outcome(transaction)

    # -- rows ----------------------------------------------------------------------------------------------------------

    def base_rows(self, state: TableState, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        paths = [self.store.path(f["path"]) for f in state.files]
        reader = spark.read.schema(state.schema.ddl)
        return reader.parquet(*paths) if paths else spark.createDataFrame([], state.schema.ddl)

    def edits(self, state: TableState, files: Sequence[str], order: Sequence[tuple[str, int]], spark: SparkSession | None = None) -> DataFrame:
        """Change files as edits, with the generation of the transaction that each row belongs to."""
        spark = spark or self.spark
        rows = spark.read.schema(f"{state.schema.ddl}, {_STATEMENT_META}").parquet(*[self.store.path(f) for f in files])
        if len(order) <= LITERAL_ORDER:
            number = F.create_map(*[x for tx, g in order for x in (F.lit(tx), F.lit(g).cast("long"))])
            return rows.withColumn("_generation", number[F.col("_tx")]).drop("_tx")
        numbers = spark.createDataFrame([(tx, int(g)) for tx, g in order], "_tx string, _generation bigint")
        return rows.join(F.broadcast(numbers), "_tx").drop("_tx")

    def rows(self, state: TableState, own: Sequence[str] = (), tx: str = "", spark: SparkSession | None = None) -> DataFrame:
        """The table's rows: base, journal and a transaction's own edits, newest first; the state's number of edits holds these too."""
        base = self.base_rows(state, spark)
        files = [*state.changes, *own]
        if not files:
            return base
        order = [*state.order, (tx, 1 << 62)] if own else list(state.order)
        return overlay.overlay(base, self.edits(state, files, order, spark), state.schema.key, state.edits)

    def write_base(self, name: str, rows: DataFrame, schema: Schema) -> list[dict]:
        """Base files, sorted by key within key ranges, with their row counts and digests."""
        folder = self.store.new_folder("data", name)
        parts = self._parts(rows)
        ranged = rows.repartitionByRange(parts, *schema.key) if parts > 1 else rows.coalesce(1)
        ranged.sortWithinPartitions(*schema.key).write.parquet(self.store.path(folder))
        made = self.store.written(folder)
        self.store.flush(made)
        self.work.files_written += len(made)
        return self.describe_files(made, schema)

    def _parts(self, rows: DataFrame) -> int:
        """Files for rows, by the bytes that they are read from; as many as shuffle partitions where Spark cannot tell these."""
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if size >= 1 << 60 else 1 + size // FILE_BYTES

    def describe_files(self, files: Sequence[str], schema: Schema) -> list[dict]:
        """Rows, least and greatest first key column and SHA-256 of files; empty ones are left out. All of it is computed by tasks; a row
        a file comes back."""
        if not files:
            return []
        paths = [self.store.path(f) for f in files]
        first = schema.column(schema.key[0])
        bound = (lambda f: f(F.col(f"`{first.name}`")).cast("string")) if first.type.name in PRUNED else (lambda f: F.lit(None).cast("string"))
        counts = self.spark.read.schema(schema.ddl).parquet(*paths).groupBy(F.col("_metadata.file_name").alias("f"))
        about = {r["f"]: r for r in counts.agg(F.count("*").alias("n"), bound(F.min).alias("low"), bound(F.max).alias("high")).collect()}
        sums = self.digests(paths)
        short = lambda f: f.rsplit("/", 1)[1]
        return [{"path": f, "rows": about[short(f)]["n"], "low": about[short(f)]["low"], "high": about[short(f)]["high"], "sha256": sums[short(f)]} for f in files if short(f) in about]

    def digests(self, paths: Sequence[str]) -> dict[str, str]:
        """SHA-256 of files by name. A file too large for one value is read in blocks."""
        if max(os.path.getsize(p) for p in paths) <= FILE_BYTES * 2:
            read = self.spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_name").alias("f"), F.sha2("content", 256).alias("s"))
        else:
            read = self.spark.createDataFrame([(p,) for p in paths], "p string").repartition(len(paths), "p").mapInPandas(_file_digests, "f string, s string")
        return {r["f"]: r["s"] for r in read.collect()}

    # -- versions ------------------------------------------------------------------------------------------------------

    def checkpoint(self, message: str = "checkpoint") -> str:
        """Folds the journal into a new version. Files without edited keys are kept as they are."""
        with self.store.lock():
            now = snapshot(self.store)
            if not now.generation:
                return now.version
            done = tuple(e["tx"] for e in self.store.journal(now.version))
            tables = {k: self._folded(s) for k, s in now.tables.items()}
            self.work.checkpoints += 1
            return self.store.publish((now.version,), message, tables, done, expected=now.version)

    def _folded(self, state: TableState) -> dict:
        files = list(state.files)
        if state.changes:
            key = list(state.schema.key)
            edits = overlay.latest_per_key(self.edits(state, state.changes, state.order), key)
            touched: set[str] = set()
            near = self._near(state, edits)
            if near:
                base = self.base_rows(replace(state, files=tuple(near))).select(*key, F.col("_metadata.file_path").alias("_file"))
                touched = {r["_file"].rsplit("/", 2)[-2] + "/" + r["_file"].rsplit("/", 1)[-1] for r in base.join(overlay.by_rows(edits.select(*key), state.edits), key, "left_semi").select("_file").distinct().collect()}
            tail = lambda p: "/".join(p.split("/")[-2:])
            rewrite = [f for f in files if tail(f["path"]) in touched]
            part = replace(state, files=tuple(rewrite))
            fresh = self.write_base(state.name, self.rows(part), state.schema)
            files = [f for f in files if tail(f["path"]) not in touched]
            self.work.files_kept += len(files)
            files += fresh
        return {"name": state.name, "schema": state.schema.to_json(), "files": files, "rows": sum(f["rows"] for f in files)}

    def _near(self, state: TableState, edits: DataFrame) -> list[dict]:
        """Base files whose range of the first key column holds an edited key; all of them where ranges are not known."""
        first = state.schema.column(state.schema.key[0])
        if first.type.name not in PRUNED or len(state.files) < 2 or any(f.get("low") is None for f in state.files):
            return list(state.files)
        kind = re.sub(r" COLLATE \w+", "", first.type.spark)
        ranges = self.spark.createDataFrame([(n, f["low"], f["high"]) for n, f in enumerate(state.files)], "n int, low string, high string")
        keys = edits.select(F.col(f"`{first.name}`").alias("k")).distinct()
        met = keys.join(F.broadcast(ranges), F.col("k").between(F.col("low").cast(kind), F.col("high").cast(kind)), "inner")
        wanted = {r["n"] for r in met.select("n").distinct().collect()}
        return [f for n, f in enumerate(state.files) if n in wanted]

    def row_count(self, table: str) -> tuple[int, bool]:
        """Rows by the entries alone, and whether the number is exact (no edits are pending)."""
        state = self._state(snapshot(self.store), table)
        return sum(f["rows"] for f in state.files), not state.changes

    @staticmethod
    def _state(at: Snapshot, table: str) -> TableState:
        try:
            return at.tables[table.lower()]
        except KeyError:
            raise DialectError(f"no table {table}") from None

    def table_at(self, table: str, version: str | None = None) -> DataFrame:
        """A table's rows at a version (none: now)."""
        return self.rows(self._state(snapshot(self.store, version, journal=version is None), table))

    def diff(self) -> dict[str, str]:
        """Tables that differ from the last version: added, modified or deleted."""
        head, now = self.store.head().tables, snapshot(self.store)
        out = {}
        for k in sorted({*head, *now.tables}):
            if k not in head:
                out[now.tables[k].name] = "added"
            elif k not in now.tables:
                out[head[k]["name"]] = "deleted"
            elif now.tables[k].changes or [f["path"] for f in head[k]["files"]] != [f["path"] for f in now.tables[k].files] or now.tables[k].schema.to_json() != head[k]["schema"]:
                out[now.tables[k].name] = "modified"
        return out

    def diff_rows(self, table: str, old: str | None = None, new: str | None = None) -> DataFrame:
        """Changed rows of a table between two versions (old: the head; new: now)."""
        old = old or self.store.head().id
        key = self._state(snapshot(self.store, old, journal=False), table).schema.key
        return merge.diff_rows(self.table_at(table, old), self.table_at(table, new), key)


def _copied(frames):
    for frame in frames:
        for a, b in zip(frame["a"], frame["b"], strict=True):
            copy_file(a, b)
        yield frame.assign(n=1)[["n"]]


def _file_digests(frames):
    """The name and SHA-256 of each file of a column of paths."""
    import hashlib

    for frame in frames:
        sums = []
        for path in frame["p"]:
            with open(path, "rb") as f:
                sums.append(hashlib.file_digest(f, "sha256").hexdigest())
        yield frame.assign(f=[p.rsplit("/", 1)[1] for p in frame["p"]], s=sums)[["f", "s"]]


class Session:
    """One user's statements. A SELECT gives a lazy DataFrame that stays bound to the files of its snapshot."""

    def __init__(self, engine: Engine):
        self.engine, self.store = engine, engine.store
        self.spark = engine.spark.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.ansi.enabled", "true")
        dialect.register(self.spark)
        self.tx: Transaction | None = None
        self.last_transaction: str | None = None

    # -- transactions --------------------------------------------------------------------------------------------------

    def begin(self, read_only: bool = False) -> Transaction:
        if self.tx:
            self.commit()
        now = snapshot(self.store)
        self.tx = Transaction(now, dict(now.tables), read_only)
        return self.tx

    def commit(self) -> str | None:
        """Publishes the transaction; it is over whether this succeeds or not. Gives its id if it changed anything."""
        tx, self.tx = self.tx, None
        if tx is None or not (tx.changes or tx.formed):
            return None
        self.last_transaction = tx.id
        try:
            if self.engine.mode == "audit":
                self._commit_version(tx)
            else:
                self._commit_journal(tx)
        except ConflictError:
            self.store.reject(tx.id)
            self.engine.work.conflicts += 1
            raise
        self.engine.work.commits += 1
        return tx.id

    def rollback(self) -> None:
        self.engine.work.rollbacks += self.tx is not None
        self.tx = None

    def _entry(self, tx: Transaction) -> dict:
        tables = {k: dict(v) for k, v in tx.formed.items()}
        for k, files in tx.changes.items():
            if not tables.get(k, {}).get("dropped"):
                tables.setdefault(k, {}).update(changes=files, edits=tx.edits[k])
        return {"tx": tx.id, "time": time.time(), "tables": tables}

    def _commit_journal(self, tx: Transaction) -> None:
        with self.store.lock():
            head = self.store.ref("data")
            if head != tx.base.version:
                raise ConflictError("a version was published since the transaction began")
            newer = self.store.journal(head, after=tx.base.generation)
            for e in newer:
                for k in {*tx.changes, *tx.formed} & {*e["tables"]}:
                    theirs = e["tables"][k]
                    if k in tx.formed or theirs.get("dropped") or "files" in theirs:
                        raise ConflictError(f"the form of {k} was changed by another transaction")
                    self._check_overlap(tx, k, theirs["changes"], theirs.get("edits", UNKNOWN))
            self.store.append(head, tx.base.generation + len(newer) + 1, self._entry(tx))

    def _check_overlap(self, tx: Transaction, k: str, theirs: Sequence[str], n: int) -> None:
        """First committer wins on rows and on values of unique keys. n: rows in their edits, at most."""
        state = tx.tables[k]
        mine, other = (self.engine.edits(state, files, [("", 0)], self.spark) for files in (tx.changes[k], theirs))
        key, other = state.schema.key, overlay.by_rows(other, n)
        if mine.join(other, overlay.same_key(mine, other, key), "left_semi").limit(1).count():
            raise ConflictError(f"rows of {state.name} were changed by another transaction")
        for i in state.schema.indexes:
            if i.unique:
                a, b = (x.where("_op = 'put'").dropna(subset=list(i.columns)) for x in (mine, other))
                if a.join(b, [a[c] == b[c] for c in i.columns], "left_semi").limit(1).count():
                    raise ConflictError(f"a value of {i.name} in {state.name} was taken by another transaction")

    def _commit_version(self, tx: Transaction) -> None:
        with self.store.lock():
            if self.store.ref("data") != tx.base.version or len(self.store.journal(tx.base.version)) != tx.base.generation:
                raise ConflictError("another transaction was committed since this one began")
            tables = {}
            for k, state in tx.tables.items():
                own = tx.changes.get(k, [])
                full = replace(state, changes=(*state.changes, *own), order=(*state.order, *([(tx.id, 1 << 62)] if own else [])), edits=state.edits + tx.edits.get(k, 0))
                tables[k] = self.engine._folded(full)
            done = (*(e["tx"] for e in self.store.journal(tx.base.version)), tx.id)
            self.store.publish((tx.base.version,), f"transaction {tx.id}", tables, done, expected=tx.base.version)

    # -- statements ----------------------------------------------------------------------------------------------------

    def query(self, text: str, args: Sequence | None = None) -> DataFrame:
        """A statement that gives rows. ``?`` in the text stand for args, by position."""
        s = router.parse(text)
        handler = getattr(self, f"_{s.kind}", None)
        if s.kind not in ("select", "explain", "describe", "show_tables", "show_databases", "show_create", "show_index"):
            raise DialectError("not a query; use execute")
        self.engine.work.queries += 1
        return handler(s, args)

    def execute(self, text: str, args: Sequence | None = None) -> int:
        """A statement that changes something; gives the number of rows it changed."""
        s = router.parse(text)
        self.engine.work.statements += 1
        if s.kind == "begin":
            self.begin(s.args["read_only"])
        elif s.kind in ("commit", "rollback"):
            getattr(self, s.kind)()
        elif s.kind == "use":
            if s.args["name"].lower() != "vellum":
                raise DialectError("there is one database, vellum")
        elif s.kind in ("insert", "update", "delete"):
            return self._change(s, args)
        elif s.kind in ("create_table", "drop_table", "alter", "add_index", "drop_index"):
            self._define(s)
        else:
            self.query(text, args)
        return 0

    def rows(self, table: str) -> DataFrame:
        """A table's rows in the present transaction, or now."""
        at = self.tx.tables if self.tx else snapshot(self.store).tables
        return self._rows_of(at, table)

    def _rows_of(self, tables: dict[str, TableState], table: str) -> DataFrame:
        state = Engine._state(Snapshot("", 0, tables), table)
        if not self.tx:
            return self.engine.rows(state, spark=self.spark)
        k = table.lower()
        return self.engine.rows(replace(state, edits=state.edits + self.tx.edits.get(k, 0)), self.tx.changes.get(k, []), self.tx.id, self.spark)

    def _bind(self, text: str) -> bool:
        """Temporary views of the tables that a text names, and of the catalog; whether one of them has an enum."""
        tables = self._tables()
        words = {router.unquote(t).lower() for t in router.tokens(text)}
        has_enum = False
        for k, state in tables.items():
            if k in words:
                seen = self._pruned(tables, k, text)
                self.engine.work.files_read += len(seen[k].files)
                self.engine.work.files_pruned += len(state.files) - len(seen[k].files)
                rows = self._rows_of(seen, k)
                enums = {c.name: c.type.values for c in state.schema.columns if c.type.name == "enum"}
                if enums:  # the members go with the column to where it is sorted
                    has_enum = True
                    rows = rows.select(*[F.col(f"`{c}`").alias(c, metadata={"enum": list(enums[c])}) if c in enums else F.col(f"`{c}`") for c in rows.columns])
                rows.createOrReplaceTempView(state.name)
        for name, rows in (("tables", self._show_tables), ("columns", self._all_columns)):
            if f"information_schema_{name}" in words:
                rows(None, None).createOrReplaceTempView(f"information_schema_{name}")
        return has_enum

    def adopt(self, rows: DataFrame, name: str) -> None:
        """A view of this session over rows of any."""
        if rows.sparkSession is not self.spark:
            plan = rows._jdf.queryExecution().logical()
            rows = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)
        rows.createOrReplaceTempView(name)

    def _pruned(self, tables: dict[str, TableState], k: str, text: str) -> dict[str, TableState]:
        """The table with the base files alone that the conditions of a simple SELECT on its key can meet; edits are read as ever."""
        state = tables[k]
        first = state.schema.column(state.schema.key[0])
        if len(state.files) < 2 or first.type.name not in PRUNED:
            return tables
        bounds = router.key_bounds(text, state.name, first.name)
        value = (lambda x: x) if first.type.name == "date" else int
        if bounds is None or (first.type.name != "date" and any(not re.fullmatch(r"-?\d+", x) for b in bounds for x in b if x is not None)):
            return tables
        if first.type.name == "date" and any(not re.fullmatch(r"\d{4}-\d\d-\d\d", x) for b in bounds for x in b if x is not None):
            return tables

        def meets(f: dict) -> bool:
            if f.get("low") is None:
                return True
            low, high = value(f["low"]), value(f["high"])
            return any((a is None or value(a) <= high) and (b is None or value(b) >= low) for a, b in bounds)

        return tables | {k: replace(state, files=tuple(f for f in state.files if meets(f)))}

    def _sql(self, text: str, args: Sequence | None) -> DataFrame:
        text = router.to_spark(text, self._outcome)
        run = lambda t: self.spark.sql(t, args=list(args)) if args else self.spark.sql(t)
        has_enum = self._bind(text if not args else router.filled(text, [literal(a) for a in args]))
        made = run(text)
        ordered = self._enum_order(text, made) if has_enum else text
        return run(ordered) if ordered != text else made

    def _outcome(self, transaction: str) -> str:
        return self.store.outcome(transaction)

    @staticmethod
    def _enum_order(text: str, made: DataFrame) -> str:
        """Enum columns in the outer ORDER BY are compared by their definition. Which these are is read from the analysed plan."""
        at = router.find_top(text, "ORDER BY")
        if at < 0:
            return text
        plan = made._jdf.queryExecution().analyzed()
        while (kind := plan.getClass().getSimpleName()) != "Sort":
            if kind not in ("Project", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "Distinct"):
                return text
            plan = plan.children().head()
        head, body = text[:at], re.sub(r"^ORDER\s+BY", "", text[at:], flags=re.I)
        cuts = [c for c in (router.find_top(body, "LIMIT"), router.find_top(body, "OFFSET")) if c >= 0]
        body, rest = (body[: min(cuts)], body[min(cuts) :]) if cuts else (body, "")
        items = router.split_top(body)
        if plan.order().size() != len(items):
            return text
        for i, item in enumerate(items):
            column = plan.order().apply(i).child()
            if column.getClass().getSimpleName() != "AttributeReference" or not column.metadata().contains("enum"):
                continue
            listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in column.metadata().getStringArray("enum"))
            m = re.match(r"(.*?)(\s+(?:ASC|DESC))?(\s+NULLS\s+(?:FIRST|LAST))?\s*$", item, re.I | re.S)
            name = f"`{column.name()}`" if m[1].strip().isdigit() else m[1]
            items[i] = f"array_position(array({listed}), {name}){m[2] or ''}{m[3] or ''}"
        return f"{head}ORDER BY {', '.join(items)} {rest}"

    def _select(self, s: Statement, args) -> DataFrame:
        counted = re.fullmatch(rf"SELECT\s+COUNT\s*\(\s*\*\s*\)(?:\s+(?:AS\s+)?{router.NAME})?\s+FROM\s+{router.NAME}", s.args["text"].strip(), re.I)
        if counted:
            state = self._tables().get((counted[3] or counted[4]).lower())
            if state and not state.changes and not (self.tx and self.tx.changes.get(state.name.lower())):
                return self.spark.createDataFrame([(sum(f["rows"] for f in state.files),)], f"`{counted[1] or counted[2] or 'count(1)'}` bigint")
        return self._sql(s.args["text"], args)

    def _explain(self, s: Statement, args) -> DataFrame:
        inner = router.parse(s.args["text"])
        if inner.kind == "select":
            df = self._sql(inner.args["text"], args)
        else:
            df = self._sql(f"SELECT * FROM `{inner.table}` WHERE {inner.args['where']}", args) if inner.kind in ("update", "delete") else self.rows(inner.table)
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in text.splitlines()], "plan string")

    # -- the catalog as rows -------------------------------------------------------------------------------------------

    def _tables(self) -> dict[str, TableState]:
        return self.tx.tables if self.tx else snapshot(self.store).tables

    def _show_tables(self, s, args) -> DataFrame:
        return self.spark.createDataFrame([("vellum", t.name) for _, t in sorted(self._tables().items())], "table_schema string, table_name string")

    def _show_databases(self, s, args) -> DataFrame:
        return self.spark.createDataFrame([("information_schema",), ("vellum",)], "database string")

    def _all_columns(self, s, args) -> DataFrame:
        rows = [(t.name, c.name, n, c.default, "YES" if c.nullable else "NO", c.type.name, c.type_text, "PRI" if c.name in t.schema.key else "") for _, t in sorted(self._tables().items()) for n, c in enumerate(t.schema.columns, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, column_type string, column_key string")

    def _describe(self, s: Statement, args) -> DataFrame:
        schema = Engine._state(Snapshot("", 0, self._tables()), s.table).schema
        unique = {i.columns[0] for i in schema.indexes if i.unique and len(i.columns) == 1}
        indexed = {i.columns[0] for i in schema.indexes}
        key = lambda c: "PRI" if c in schema.key else "UNI" if c in unique else "MUL" if c in indexed else ""
        return self.spark.createDataFrame([(c.name, c.type_text, "YES" if c.nullable else "NO", key(c.name), c.default) for c in schema.columns], "field string, type string, null string, key string, default string")

    def _show_create(self, s: Statement, args) -> DataFrame:
        state = Engine._state(Snapshot("", 0, self._tables()), s.table)
        return self.spark.createDataFrame([(state.name, create_text(state))], "table string, create_table string")

    def _show_index(self, s: Statement, args) -> DataFrame:
        schema = Engine._state(Snapshot("", 0, self._tables()), s.table).schema
        rows = [("PRIMARY", 0, n, c) for n, c in enumerate(schema.key, 1)]
        rows += [(i.name, int(not i.unique), n, c) for i in schema.indexes for n, c in enumerate(i.columns, 1)]
        return self.spark.createDataFrame(rows, "key_name string, non_unique int, seq_in_index int, column_name string")

    # -- data changes --------------------------------------------------------------------------------------------------

    def _change(self, s: Statement, args) -> int:
        alone = self.tx is None
        if alone:
            self.begin()
        if self.tx.read_only:
            raise TransactionError("the transaction is read only")
        try:
            state = Engine._state(Snapshot("", 0, self.tx.tables), s.table)
            n = getattr(self, f"_{s.kind}")(s, state, args)
        except Exception:
            if alone:
                self.rollback()
            raise
        if alone:
            self.commit()
        self.engine.work.rows_changed += n
        return n

    def _most(self, state: TableState) -> int:
        """Rows of a table in the present transaction, at most."""
        return state.most + self.tx.edits.get(state.name.lower(), 0)

    def _stored(self, rows: DataFrame, schema: Schema) -> DataFrame:
        return rows.select(*[c.type.store(F.col(c.name)).cast(c.type.spark).alias(c.name) for c in schema.columns])

    def _materialise(self, state: TableState, edits: DataFrame) -> tuple[list[str], DataFrame]:
        """Writes edits (_op, columns) as change files of the present statement and reads them back."""
        folder = self.store.new_folder("changes", state.name)
        seq = self.tx.statements
        rows = edits.select(*state.schema.names, "_op", F.lit(seq).cast("long").alias("_seq"), F.lit(self.tx.id).alias("_tx"))
        rows.write.parquet(self.store.path(folder))
        files = self.store.written(folder)
        self.store.flush(files)
        self.engine.work.files_written += len(files)
        return files, self.spark.read.schema(f"{state.schema.ddl}, {_STATEMENT_META}").parquet(*[self.store.path(f) for f in files]) if files else rows

    def _apply(self, state: TableState, edits: DataFrame, checked, each: int = 1) -> int:
        """Writes edits, checks the written rows, and lets them belong to the transaction only if they pass. Gives the rows put, each of
        which stands for so many edits at most."""
        files, written = self._materialise(state, edits)
        n = checked(written) if files else 0
        if files:
            k = state.name.lower()
            self.tx.changes.setdefault(k, []).extend(files)
            self.tx.edits[k] = self.tx.edits.get(k, 0) + n * each
        self.tx.statements += 1
        return n

    def _check(self, state: TableState, current: DataFrame, gone: DataFrame | None = None, changed: Sequence[str] | None = None, removed: int | None = None):
        """A check of written edits against the table without the keys that the statement removes (gone, and its deletions; removed says
        how many at most, if not as many as the rows put).

        One query counts the rows and what is wrong in them; a second looks for clashes of the keys that hold a changed
        column (None: all).
        """
        schema = state.schema

        def run(written: DataFrame) -> int:
            new = written.where("_op = 'put'").select(*schema.names)
            wrong = {f"a NOT NULL column of {state.name} is null": constraints.any_null([c.name for c in schema.columns if not c.nullable])}
            wrong["NaN cannot be a key"] = constraints.any_nan(new, schema.key)
            for c in schema.checks:
                if c.enforced:
                    wrong[f"check {c.name} of {state.name} is violated"] = ~F.coalesce(F.expr(router.to_spark(c.predicate)), F.lit(True))
            found = new.agg(F.count("*").alias("n"), *[F.count(F.when(w, 1)).alias(f"w{i}") for i, w in enumerate(wrong.values())]).first()
            for i, what in enumerate(wrong):
                if found[f"w{i}"]:
                    raise ConstraintError(what)
            keys = [("PRIMARY", schema.key), *[(i.name, i.columns) for i in schema.indexes if i.unique]]
            keys = [(name, columns) for name, columns in keys if changed is None or not set(changed).isdisjoint(columns)]
            if keys and found["n"]:
                left = overlay.by_rows(written.where("_op = 'del'").select(*schema.key) if gone is None else gone, found["n"] if removed is None else removed)
                rest = overlay.by_rows(current.join(left, overlay.same_key(current, left, schema.key), "left_anti"), self._most(state))
                clashes = None
                for name, columns in keys:
                    whole = new.dropna(subset=list(columns))
                    for bad in (constraints.duplicate_keys(whole, columns), constraints.existing_keys(whole, rest, columns)):
                        one = bad.select(F.lit(name).alias("name")).limit(1)
                        clashes = one if clashes is None else clashes.unionByName(one)
                clash = clashes.limit(1).collect()
                if clash:
                    raise ConstraintError(f"duplicate entry for key {clash[0]['name']} of {state.name}")
            return found["n"]

        return run

    def _source(self, s: Statement, state: TableState, args) -> DataFrame:
        """The rows of an INSERT with all columns, defaults filled in, in the order they were given (_at)."""
        schema = state.schema
        names = [schema.column(c).name for c in (s.args["columns"] or schema.names)]
        types = {c.name: "string" if c.type.name == "time" else re.sub(r" COLLATE \w+", "", c.type.spark) for c in schema.columns}
        defaults = {c.name: router.to_spark(c.default) for c in schema.columns if c.default is not None}
        if "rows" in s.args:
            parts = []
            for row in s.args["rows"]:
                if len(row) != len(names):
                    raise DialectError(f"{len(row)} values for {len(names)} columns")
                filled = [defaults.get(n, "NULL") if v.upper() == "DEFAULT" else router.to_spark(v) for n, v in zip(names, row, strict=True)]
                parts.append("(" + ", ".join(f"CAST(({v}) AS STRING)" if types[n] == "string" else v for n, v in zip(names, filled, strict=True)) + f", {len(parts)}L)")
            columns = ", ".join(f"`{n}`" for n in [*names, "_at"])
            text = f"SELECT * FROM VALUES {', '.join(parts)} AS t({columns})"
            rows = self.spark.sql(text, args=list(args)) if args else self.spark.sql(text)
        else:
            rows = self._sql(s.args["select"], args)
            if len(rows.columns) != len(names):
                raise DialectError(f"{len(rows.columns)} values for {len(names)} columns")
            rows = rows.toDF(*names).withColumn("_at", F.monotonically_increasing_id())
        filled = rows.select(*[(F.col(c) if c in names else F.expr(defaults.get(c, "NULL"))).alias(c) for c in schema.names], "_at")
        return filled.select(*[c.type.store(F.col(c.name)).cast(c.type.spark).alias(c.name) for c in schema.columns], "_at")

    def _insert(self, s: Statement, state: TableState, args) -> int:
        schema, current = state.schema, self._rows_of(self.tx.tables, state.name)
        rows = self._source(s, state, args)
        if s.args["ignore"] or s.args["updates"]:
            rows = self._held(rows, state)
        if s.args["ignore"]:
            rows, current = dml.first_per_key(rows, schema.key, ["_at"]), overlay.by_rows(current, self._most(state))
            for columns in [schema.key, *[i.columns for i in schema.indexes if i.unique]]:
                rows = rows.join(current, overlay.same_key(rows, current, columns), "left_anti") if columns == schema.key else self._unclaimed(rows, current, columns)
            edits = rows
        elif s.args["updates"]:
            return self._upsert(s, state, rows, current)
        else:
            edits = rows
        made = edits.select(*schema.names, F.lit("put").alias("_op"))
        return self._apply(state, made, self._check(state, current, current.select(*schema.key).limit(0)))

    def _unclaimed(self, rows: DataFrame, current: DataFrame, columns) -> DataFrame:
        """Rows whose unique values nobody has; of several new ones, the first. Nulls claim nothing."""
        free = rows.join(current, [rows[c] == current[c] for c in columns], "left_anti")
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull()
        return dml.first_per_key(free.where(whole), columns, ["_at"]).unionByName(free.where(~whole))

    def _held(self, rows: DataFrame, state: TableState) -> DataFrame:
        """Evaluates rows once: they are read several times and may not be the same twice."""
        folder = self.store.new_folder("changes", state.name)
        rows.write.parquet(self.store.path(folder))
        return self.spark.read.schema(f"{state.schema.ddl}, `_at` bigint").parquet(self.store.path(folder))

    def _upsert(self, s: Statement, state: TableState, rows: DataFrame, current: DataFrame) -> int:
        schema = state.schema
        if constraints.duplicate_keys(rows, schema.key).limit(1).count():
            raise ConstraintError("one statement names a key twice")
        values = {schema.column(c).name: re.sub(r"\bVALUES\s*\(\s*`?(\w+)`?\s*\)", r"new.\1", router.to_spark(v), flags=re.I) for c, v in s.args["updates"].items()}
        n = rows.count()
        rows = overlay.by_rows(rows, n)
        touched = current.join(rows, overlay.same_key(current, rows, schema.key), "left_semi")
        after = dml.upsert(touched, rows.drop("_at"), schema.key, values)
        old = overlay.by_rows(touched.select(F.struct(*schema.names).alias("_old"), *[F.col(k).alias(k) for k in schema.key]), n)
        changed = after.join(old, overlay.same_key(after, old, schema.key), "left").select(*[after[c] for c in schema.names], "_old")
        changed = changed.where(~F.struct(*schema.names).eqNullSafe(F.col("_old"))).select(*schema.names)
        gone = touched.select(*schema.key)
        edits = self._stored(changed, schema).select("*", F.lit("put").alias("_op"))
        return self._apply(state, edits, self._check(state, current, gone, removed=n))

    def _update(self, s: Statement, state: TableState, args) -> int:
        schema, current = state.schema, self._rows_of(self.tx.tables, state.name)
        set_ = {schema.column(c).name: v for c, v in s.args["set"].items()}
        values = [schema.column(c).default or "NULL" if v.strip().upper() == "DEFAULT" else v for c, v in set_.items()]
        made = "".join(f", ({v}) AS `_v{i}`" for i, v in enumerate(values))
        hit = self._sql(f"SELECT `{state.name}`.*{made} FROM `{state.name}` WHERE {s.args['where']}", args)
        value = {c: schema.column(c).type.store(F.col(f"_v{i}")).cast(schema.column(c).type.spark) for i, c in enumerate(set_)}
        new = [value[n].alias(n) if n in value else F.col(f"`{n}`") for n in schema.names]
        pairs = hit.select(F.struct(*schema.names).alias("old"), F.struct(*new).alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
        edits = pairs.select("new.*").select("*", F.lit("put").alias("_op"))
        if set(value).isdisjoint(schema.key):
            gone = pairs.select(*[F.col(f"old.{k}").alias(k) for k in schema.key]) if not set(value).isdisjoint(c for i in schema.indexes if i.unique for c in i.columns) else None
            return self._apply(state, edits, self._check(state, current, gone, list(value)))
        moved = F.lit(False)
        for k in schema.key:
            moved = moved | ~F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
        left = pairs.where(moved).select(*[F.col(f"old.{k}").alias(k) for k in schema.key])
        # a key that one row leaves and another takes keeps the row: the put of a statement wins over its deletion
        taken = overlay.by_rows(pairs.select(*[F.col(f"new.{k}").alias(k) for k in schema.key]), self._most(state))
        deletions = overlay.deletions(left, current, schema.key).select(*schema.names, "_op")
        deletions = deletions.join(taken, overlay.same_key(deletions, taken, schema.key), "left_anti")
        old_keys = pairs.select(*[F.col(f"old.{k}").alias(k) for k in schema.key])
        return self._apply(state, edits.unionByName(deletions), self._check(state, current, old_keys, list(value)), 2)

    def _delete(self, s: Statement, state: TableState, args) -> int:
        schema, current = state.schema, self._rows_of(self.tx.tables, state.name)
        keys = self._sql(f"SELECT {', '.join(f'`{k}`' for k in schema.key)} FROM `{state.name}` WHERE {s.args['where']}", args)
        return self._apply(state, overlay.deletions(keys, current, schema.key).select(*schema.names, "_op"), lambda written: written.count())

    # -- definitions ---------------------------------------------------------------------------------------------------

    def _define(self, s: Statement) -> None:
        """DDL ends the present transaction and is one of its own."""
        if self.tx and self.tx.read_only:
            raise TransactionError("the transaction is read only")
        self.commit()
        self.begin()
        try:
            k = s.table.lower()
            if s.kind == "create_table":
                if k in self.tx.tables:
                    if s.args["if_not_exists"]:
                        return
                    raise DialectError(f"table {s.table} exists")
                self._form(s.table, s.args["schema"], None)
            elif s.kind == "drop_table":
                if k not in self.tx.tables:
                    if s.args["if_exists"]:
                        return
                    raise DialectError(f"no table {s.table}")
                self.tx.formed[k] = {"dropped": True}
                del self.tx.tables[k]
            else:
                changes = s.args["changes"] if s.kind == "alter" else [(s.kind, s.args)]
                for name, args in changes:
                    state = Engine._state(Snapshot("", 0, self.tx.tables), s.table)
                    getattr(self, f"_alter_{name}")(state, **args)
            self.commit()
        finally:
            self.rollback()

    def _form(self, name: str, schema: Schema, rows: DataFrame | None) -> None:
        """Gives a table a schema, with new rows or (None) the ones it has."""
        schema, k = schema.validated(), name.lower()
        if rows is None:
            old = self.tx.tables.get(k)
            if old is None:
                files = []
            elif not old.changes:
                files = list(old.files)
            else:
                files = self.engine.write_base(name, self._rows_of(self.tx.tables, name), schema)
        else:
            files = self.engine.write_base(name, rows, schema)
        self.tx.formed[k] = {"name": name, "schema": schema.to_json(), "files": files}
        self.tx.tables[k] = TableState(name, schema, tuple(files))
        self.tx.changes.pop(k, None)
        self.tx.edits.pop(k, None)

    def _rows_now(self, state: TableState) -> DataFrame:
        return self._rows_of(self.tx.tables, state.name)

    def _alter_add_column(self, state, column, first=False, after=None) -> None:
        schema = state.schema
        if schema.has(column.name):
            raise DialectError(f"column {column.name} exists")
        rows = self._rows_now(state)
        if not column.nullable and column.default is None and rows.limit(1).count():
            raise ConstraintError(f"{column.name} is NOT NULL without a default and the table has rows")
        after = schema.column(after).name if after else None
        order = ddl.placed(schema.names, column.name, first, after)
        made = {c.name: c for c in (*schema.columns, column)}
        value = column.type.store(F.expr(router.to_spark(column.default or "NULL"))).cast(column.type.spark)
        self._form(state.name, replace(schema, columns=tuple(made[n] for n in order)), rows.withColumn(column.name, value).select(*order))

    def _alter_drop_column(self, state, name) -> None:
        schema, name = state.schema, state.schema.column(name).name
        for i in schema.indexes:
            if name in i.columns:
                raise DialectError(f"{name} belongs to index {i.name}")
        key = tuple(k for k in schema.key if k != name)
        if not key:
            raise DialectError("the primary key cannot be dropped")
        rows = ddl.drop_column(self._rows_now(state), name)
        if key != schema.key and constraints.duplicate_keys(rows, key).limit(1).count():
            raise ConstraintError("the rest of the primary key is not unique")
        self._form(state.name, replace(schema, columns=tuple(c for c in schema.columns if c.name != name), key=key), rows)

    def _alter_modify_column(self, state, name, column, first=False, after=None) -> None:
        schema, name = state.schema, state.schema.column(name).name
        if column.name.lower() != name.lower() and schema.has(column.name):
            raise DialectError(f"column {column.name} exists")
        rename = lambda n: column.name if n == name else n
        columns = {rename(c.name): column if c.name == name else c for c in schema.columns}
        names = [rename(n) for n in schema.names]
        after = rename(schema.column(after).name) if after else None
        order = ddl.placed(names, column.name, first, after) if first or after else names
        made = Schema(
            tuple(columns[n] for n in order), tuple(rename(k) for k in schema.key), tuple(replace(i, columns=tuple(rename(c) for c in i.columns)) for i in schema.indexes), tuple(replace(c, predicate=_renamed(c.predicate, name, column.name)) for c in schema.checks)
        ).validated()
        rows = self._rows_now(state).withColumnRenamed(name, column.name).withColumn(column.name, column.type.store(F.col(column.name)).cast(column.type.spark)).select(*order)
        self._form(state.name, made, rows)
        written = self._rows_now(self.tx.tables[state.name.lower()])
        if not made.column(column.name).nullable and constraints.null_keys(written, [column.name]).limit(1).count():
            raise ConstraintError(f"{column.name} has nulls")
        self._check_unique(state.name, made, written, column.name)

    def _check_unique(self, name: str, schema: Schema, rows: DataFrame, column: str) -> None:
        for label, columns in [("PRIMARY", schema.key), *[(i.name, i.columns) for i in schema.indexes if i.unique]]:
            if column in columns and constraints.unique_violations(rows, columns).limit(1).count():
                raise ConstraintError(f"duplicate entry for key {label} of {name}")

    def _alter_rename_column(self, state, name, to) -> None:
        old = state.schema.column(name)
        self._alter_modify_column(state, name, replace(old, name=to))

    def _alter_add_index(self, state, index) -> None:
        schema = state.schema
        index = replace(index, columns=tuple(schema.column(c).name for c in index.columns))
        made = replace(schema, indexes=(*schema.indexes, index)).validated()
        if index.unique and constraints.unique_violations(self._rows_now(state), index.columns).limit(1).count():
            raise ConstraintError(f"duplicate entry for key {index.name} of {state.name}")
        self._form(state.name, made, None)

    def _alter_drop_index(self, state, name) -> None:
        state.schema.index(name)
        self._form(state.name, replace(state.schema, indexes=tuple(i for i in state.schema.indexes if i.name != name)), None)

    def _alter_rename_index(self, state, name, to) -> None:
        state.schema.index(name)
        self._form(state.name, replace(state.schema, indexes=tuple(replace(i, name=to) if i.name == name else i for i in state.schema.indexes)), None)

    def _alter_add_check(self, state, name, predicate, enforced) -> None:
        schema = state.schema
        name = name or router.check_name(state.name, schema.checks)
        if any(c.name == name for c in schema.checks):
            raise DialectError(f"check {name} exists")
        if enforced and constraints.check_violations(self._rows_now(state), router.to_spark(predicate)).limit(1).count():
            raise ConstraintError(f"rows of {state.name} violate the check {name}")
        self._form(state.name, replace(schema, checks=(*schema.checks, Check(name, predicate, enforced))), None)

    def _alter_drop_check(self, state, name) -> None:
        if all(c.name != name for c in state.schema.checks):
            raise DialectError(f"no check {name}")
        self._form(state.name, replace(state.schema, checks=tuple(c for c in state.schema.checks if c.name != name)), None)


def _renamed(predicate: str, old: str, new: str) -> str:
    return "".join(new if router.unquote(t).lower() == old.lower() else t for t in router.tokens(predicate, spaces=True))


def literal(value) -> str:
    """A value as a literal of Spark SQL."""
    import datetime
    import decimal

    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"CAST({value} AS DECIMAL(20,0))" if not -(1 << 63) <= value < 1 << 63 else str(value) if abs(value) < 1 << 31 else f"{value}L"
    if isinstance(value, float):
        return f"CAST('{value}' AS DOUBLE)"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, bytes | bytearray | memoryview):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, datetime.datetime):
        if value.tzinfo:
            value = value.astimezone(datetime.UTC).replace(tzinfo=None)
        return f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_text(state: TableState) -> str:
    """A CREATE TABLE statement that makes the table's form."""
    s, lines = state.schema, []
    for c in s.columns:
        default = f" DEFAULT ({c.default})" if c.default is not None else ""
        lines.append(f"  `{c.name}` {c.type_text}{'' if c.nullable else ' NOT NULL'}{default}")
    lines.append(f"  PRIMARY KEY ({', '.join(f'`{k}`' for k in s.key)})")
    lines += [f"  {'UNIQUE ' if i.unique else ''}KEY `{i.name}` ({', '.join(f'`{c}`' for c in i.columns)})" for i in s.indexes]
    lines += [f"  CONSTRAINT `{c.name}` CHECK ({c.predicate}){'' if c.enforced else ' NOT ENFORCED'}" for c in s.checks]
    return f"CREATE TABLE `{state.name}` (\n" + ",\n".join(lines) + "\n)"


def open_engine(root, spark: SparkSession, mode: str = "journal", durability: str = "full", create: bool = True) -> Engine:
    return Engine(Store.init(root, durability) if create else Store.open(root, durability), spark, mode)

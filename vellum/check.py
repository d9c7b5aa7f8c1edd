"""Integrity: entries against their hashes, files against their digests and schemas, rows against keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from vellum.catalog import Schema
from vellum.operators import constraints
from vellum.session import Engine, snapshot
from vellum.sources.store import version_id


@dataclass
class Report:
    versions: int = 0
    files: int = 0
    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems


def check(engine: Engine, version: str | None = None, everything: bool = False) -> Report:
    """Checks the head with its journal, one version, or all that the head contains. A file is read once, however many versions name it."""
    store, out, seen = engine.store, Report(), set()
    ids = list(store.ancestors(store.ref("data"))) if everything else [version or store.ref("data")]
    for id in ids:
        out.versions += 1
        try:
            body = json.loads((store.root / "_versions" / f"{id}.json").read_text())
        except (OSError, ValueError) as e:
            out.problems.append(f"version {id}: {e}")
            continue
        if version_id(body) != id:
            out.problems.append(f"version {id} does not have its own hash")
        for k, t in body["tables"].items():
            _table(engine, id, k, t, out, seen)
    if not version:
        try:
            now = snapshot(store)
        except Exception as e:  # noqa: BLE001  a damaged journal is a finding
            out.problems.append(f"journal: {e}")
            return out
        for state in now.tables.values():
            gone = [f for f in state.changes if not (store.root / f).exists()]
            out.problems += [f"{state.name}: change file {f} is missing" for f in gone]
            if state.changes and not gone:
                _rows(engine.rows(state), state.schema, state.name, out)
    out.warnings += [f"unreferenced: {f}" for f in store.unreferenced()]
    return out


def _table(engine: Engine, id: str, k: str, t: dict, out: Report, seen: set) -> None:
    store = engine.store
    try:
        schema = Schema.from_json(t["schema"]).validated()
    except Exception as e:  # noqa: BLE001
        out.problems.append(f"{id[:8]} {k}: schema: {e}")
        return
    missing = [f["path"] for f in t["files"] if not (store.root / f["path"]).exists()]
    out.problems += [f"{id[:8]} {k}: file {f} is missing" for f in missing]
    if missing:
        return
    new = [f for f in t["files"] if f["path"] not in seen]
    seen.update(f["path"] for f in new)
    out.files += len(new)
    damaged = False
    if new:
        try:
            sums = engine.digests([store.path(f["path"]) for f in new])
        except Exception:  # noqa: BLE001  a file that cannot be read stops the job and is named by reading one at a time
            sums = {f["path"].rsplit("/", 1)[1]: store.sha256(f["path"]) for f in new}
        for f in new:
            if sums.get(f["path"].rsplit("/", 1)[1]) != f["sha256"]:
                damaged = True
                out.problems.append(f"{id[:8]} {k}: file {f['path']} does not have its digest")
    if sum(f["rows"] for f in t["files"]) != t["rows"]:
        out.problems.append(f"{id[:8]} {k}: row counts do not add up")
    if new and not damaged:
        rows = engine.spark.read.parquet(*[store.path(f["path"]) for f in t["files"]])
        if rows.columns != schema.names:
            out.problems.append(f"{id[:8]} {k}: columns are {rows.columns}")
            return
        rows = engine.spark.read.schema(schema.ddl).parquet(*[store.path(f["path"]) for f in t["files"]])
        if rows.count() != t["rows"]:
            out.problems.append(f"{id[:8]} {k}: {t['rows']} rows are recorded")
        _rows(rows, schema, k, out)


def _rows(rows, schema: Schema, name: str, out: Report) -> None:
    if constraints.null_keys(rows, [c.name for c in schema.columns if not c.nullable]).limit(1).count():
        out.problems.append(f"{name}: a NOT NULL column is null")
    for label, columns in [("PRIMARY", schema.key), *[(i.name, i.columns) for i in schema.indexes if i.unique]]:
        if constraints.unique_violations(rows, columns).limit(1).count():
            out.problems.append(f"{name}: duplicate values of {label}")

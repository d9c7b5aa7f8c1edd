"""Table schemas: columns, key, checks, indexes; kept as JSON in versions and journal entries."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from vellum.functions.dialect import ColumnType, DialectError, parse_type


@dataclass(frozen=True)
class Column:
    name: str
    type_text: str
    nullable: bool = True
    default: str | None = None

    @property
    def type(self) -> ColumnType:
        return parse_type(self.type_text)


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Check:
    name: str
    predicate: str
    enforced: bool = True


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    indexes: tuple[Index, ...] = ()
    checks: tuple[Check, ...] = field(default=())

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise DialectError(f"unknown column {name}")

    def has(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.type.spark}" for c in self.columns)

    def index(self, name: str) -> Index:
        for i in self.indexes:
            if i.name == name:
                return i
        raise DialectError(f"unknown index {name}")

    def validated(self) -> Schema:
        """Rejects what no table may have."""
        if not self.key:
            raise DialectError("a table needs a primary key")
        seen = [c.name.lower() for c in self.columns]
        if len(set(seen)) < len(seen):
            raise DialectError("a column name occurs twice")
        if len({i.name for i in self.indexes}) < len(self.indexes):
            raise DialectError("an index name occurs twice")
        for c in self.columns:
            c.type  # noqa: B018  raises on an unsupported type
        for k in [*self.key, *(c for i in self.indexes for c in i.columns)]:
            if not self.column(k).type.is_key:
                raise DialectError(f"a JSON column cannot be a key: {k}")
        keyed = {k.lower() for k in self.key}
        columns = tuple(replace(c, nullable=False) if c.name.lower() in keyed else c for c in self.columns)
        return replace(self, columns=columns, key=tuple(self.column(k).name for k in self.key))

    def to_json(self) -> dict:
        return {
            "columns": [{"name": c.name, "type": c.type_text, "nullable": c.nullable, "default": c.default} for c in self.columns],
            "key": list(self.key),
            "indexes": [{"name": i.name, "columns": list(i.columns), "unique": i.unique} for i in self.indexes],
            "checks": [{"name": c.name, "predicate": c.predicate, "enforced": c.enforced} for c in self.checks],
        }

    @staticmethod
    def from_json(data: dict) -> Schema:
        return Schema(
            tuple(Column(c["name"], c["type"], c["nullable"], c["default"]) for c in data["columns"]),
            tuple(data["key"]),
            tuple(Index(i["name"], tuple(i["columns"]), i["unique"]) for i in data["indexes"]),
            tuple(Check(c["name"], c["predicate"], c["enforced"]) for c in data["checks"]),
        )

"""The SQL dialect: column types, collations, function names and their Spark forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions that Spark lacks under these names; Catalyst inlines them.
FUNCTIONS = {
    "json_extract": "CREATE OR REPLACE TEMPORARY FUNCTION json_extract(doc STRING, path STRING) RETURNS STRING RETURN to_json(variant_get(parse_json(doc), path))",
    "json_unquote": "CREATE OR REPLACE TEMPORARY FUNCTION json_unquote(doc STRING) RETURNS STRING RETURN CASE WHEN doc LIKE '\"%\"' THEN from_json(concat('[', doc, ']'), 'ARRAY<STRING>')[0] ELSE doc END",
}


def register(spark: SparkSession) -> None:
    """Defines the functions, once a session."""
    if spark.conf.get("vellum.functions", "") != "1":
        for text in FUNCTIONS.values():
            spark.sql(text)
        spark.conf.set("vellum.functions", "1")


#: Collation families of the dialect and Spark's nearest ones.
COLLATIONS = {"utf8mb4_bin": None, "utf8mb4_0900_bin": None, "binary": None, "utf8mb4_general_ci": "UTF8_LCASE", "utf8mb4_unicode_ci": "UNICODE_CI", "utf8mb4_0900_ai_ci": "UNICODE_CI_AI"}
DEFAULT_COLLATION = "utf8mb4_0900_bin"

INTEGERS = {"tinyint": ("tinyint", -(2**7), 2**7 - 1), "smallint": ("smallint", -(2**15), 2**15 - 1), "mediumint": ("int", -(2**23), 2**23 - 1), "int": ("int", -(2**31), 2**31 - 1), "bigint": ("bigint", -(2**63), 2**63 - 1)}
UNSIGNED = {"tinyint": ("smallint", 2**8 - 1), "smallint": ("int", 2**16 - 1), "mediumint": ("int", 2**24 - 1), "int": ("bigint", 2**32 - 1), "bigint": ("decimal(20,0)", 2**64 - 1)}
ALIASES = {"bool": "tinyint", "boolean": "tinyint", "integer": "int", "numeric": "decimal", "dec": "decimal", "real": "double", "double precision": "double", "tinytext": "text", "mediumtext": "text", "longtext": "text", "tinyblob": "blob", "mediumblob": "blob", "longblob": "blob"}
REJECTED = frozenset("year set bit geometry point linestring polygon vector array map struct interval serial".split())


class DialectError(ValueError):
    """A statement, type or value that the dialect does not have."""


@dataclass(frozen=True)
class ColumnType:
    """A declared type: its name, arguments and the Spark type that stores it."""

    name: str
    spark: str
    length: int | None = None
    low: int | None = None
    high: int | None = None
    precision: int | None = None
    values: tuple[str, ...] = ()
    collation: str | None = None

    @property
    def is_key(self) -> bool:
        return self.name != "json"

    def store(self, value: Column) -> Column:
        """The stored form of a value: an ANSI cast, rounded, canonical; fails on what does not fit."""
        name = self.name
        if name == "json":
            return F.to_json(F.parse_json(value.cast("string")))
        if name == "time":
            return parse_time(value, self.precision or 0)
        out = value.cast(re.sub(r" COLLATE \w+", "", self.spark))
        if name in ("datetime", "timestamp") and self.precision is not None and self.precision < 6:
            second = F.extract(F.lit("SECOND"), out)
            shift = (F.round(second, self.precision) - second).cast("decimal(18,6)")
            out = (out + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift)).cast(self.spark)
        if self.low is not None and (name == "mediumint" or "unsigned" in name):
            fits = out.isNull() | ((out >= F.lit(self.low)) & (out <= F.lit(str(self.high)).cast("decimal(20,0)")))
            out = F.when(fits, out).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {name}: "), out.cast("string"))).cast(self.spark))
        if self.length is not None and name in ("char", "varchar", "text"):
            fits = out.isNull() | (F.length(out) <= self.length)
            out = F.when(fits, out).otherwise(F.raise_error(F.lit(f"data too long for {name}({self.length})")).cast("string"))
        if name == "enum":
            fits = out.isNull() | out.isin(list(self.values))
            out = F.when(fits, out).otherwise(F.raise_error(F.concat(F.lit("not a member of the enum: "), out)).cast("string"))
        return out.cast(self.spark)

    def order(self, column: Column) -> Column:
        """What ORDER BY compares: an enum goes by its definition."""
        return F.array_position(F.array(*[F.lit(v) for v in self.values]), column) if self.name == "enum" else column


def parse_time(value: Column, precision: int = 6) -> Column:
    """'[-]H:MM[:SS[.ffffff]]' up to 838:59:59 as an interval, rounded to a number of digits."""
    text = value.cast("string")
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, r"^(-?)(\d{1,3}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?$", i), F.lit("")), F.lit("0"))
    micros = ((part(2).cast("long") * 60 + part(3).cast("long")) * 60 + part(4).cast("long")) * 1000000 + F.rpad(part(5), 6, "0").cast("long")
    micros = (F.round(micros / 10 ** (6 - precision)) * 10 ** (6 - precision)).cast("long")
    fits = text.rlike(r"^-?\d{1,3}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?$") & (micros <= 3020399000000) & (part(3).cast("int") < 60) & (part(4).cast("int") < 60)
    signed = F.when(text.startswith("-"), -micros).otherwise(micros)
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (signed / 1000000).cast("decimal(18,6)")).cast("interval hour to second")
    return F.when(text.isNull(), F.lit(None)).when(fits, span).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("interval hour to second"))


def format_time(value: Column, precision: int = 0) -> Column:
    """An interval as '[-]HH:MM:SS[.fff]'."""
    value = value.cast("interval day to second")
    micros = (F.extract(F.lit("DAY"), value).cast("long") * 86400 + F.extract(F.lit("HOUR"), value).cast("long") * 3600 + F.extract(F.lit("MINUTE"), value).cast("long") * 60) * 1000000 + (F.extract(F.lit("SECOND"), value).cast("decimal(18,6)") * 1000000).cast("long")
    size = F.abs(micros)
    seconds = (size / 1000000).cast("long")
    text = F.concat(F.when(micros < 0, "-").otherwise(""), F.when(seconds < 360000, F.lpad((seconds / 3600).cast("long").cast("string"), 2, "0")).otherwise((seconds / 3600).cast("long").cast("string")), F.lit(":"), F.lpad(((seconds / 60).cast("long") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))
    if precision:
        text = F.concat(text, F.lit("."), F.substring(F.lpad((size % 1000000).cast("string"), 6, "0"), 1, precision))
    return text


def parse_type(text: str) -> ColumnType:
    """A column type of the dialect, as it stands in a definition (attributes such as COLLATE may follow)."""
    m = re.match(r"\s*(double\s+precision|[a-z]+)(?:\s*(\(([^()]*)\)))?((?:\s+(?:unsigned|signed|zerofill))*)", text, re.I)
    if not m:
        raise DialectError(f"not a type: {text}")
    name, arguments = re.sub(r"\s+", " ", m.group(1).lower()), m.group(3)
    name = ALIASES.get(name, name)
    numbers = [int(x) for x in re.findall(r"\d+", arguments or "")]
    found = re.search(r"\bcollate\s+(\w+)", text, re.I)
    collation = (found.group(1) if found else DEFAULT_COLLATION).lower()
    if name in INTEGERS:
        kind, low, high = INTEGERS[name]
        if "unsigned" in m.group(4).lower():
            kind, high = UNSIGNED[name]
            return ColumnType(name + " unsigned", kind, low=0, high=high)
        return ColumnType(name, kind, low=low, high=high)
    if name in ("float", "double"):
        return ColumnType(name, name)
    if name == "decimal":
        p, s = (numbers + [10, 0][len(numbers) :])[:2]
        if p > 65 or s > 30 or s > p:
            raise DialectError(f"DECIMAL({p},{s}) is out of range")
        if p > 38:
            raise DialectError(f"DECIMAL({p},{s}): more than 38 digits are not supported here")
        return ColumnType(name, f"decimal({p},{s})", precision=p)
    if name in ("char", "varchar", "text"):
        if collation not in COLLATIONS:
            raise DialectError(f"unknown collation {collation}")
        own = COLLATIONS[collation]
        if name == "char":
            own = f"{own or 'UTF8_BINARY'}_RTRIM"
        length = numbers[0] if numbers else 1 if name == "char" else 65535
        return ColumnType(name, f"string COLLATE {own}" if own else "string", length=length, collation=collation)
    if name in ("binary", "varbinary", "blob"):
        return ColumnType(name, "binary", length=numbers[0] if numbers else None)
    if name == "date":
        return ColumnType(name, "date")
    if name in ("datetime", "timestamp", "time"):
        p = numbers[0] if numbers else 0
        if p > 6:
            raise DialectError(f"{name}({p}): at most 6 digits")
        return ColumnType(name, {"datetime": "timestamp_ntz", "timestamp": "timestamp", "time": "interval hour to second"}[name], precision=p)
    if name == "json":
        return ColumnType(name, "string")
    if name == "enum":
        values = tuple(v.replace("''", "'") for v in re.findall(r"'((?:[^']|'')*)'", arguments or ""))
        if not values:
            raise DialectError("an enum needs members")
        return ColumnType(name, "string", values=values)
    raise DialectError(f"unsupported SQL type {name}")

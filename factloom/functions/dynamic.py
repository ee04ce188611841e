"""Dynamic values of custom facts: JSON text in, VARIANT inside, scalars out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("string", "number", "boolean", "array", "object")


def field(data: Column, key: str, kind: str = "string") -> Column:
    """A field of a dynamic value, or null where it is missing or of another type."""
    return F.try_variant_get(F.try_parse_json(data), f"$.{key}", kind)


def value_type(data: Column) -> Column:
    """One of the five type names, or null."""
    kind = F.schema_of_variant(F.try_parse_json(data))
    out = F.when(kind == "STRING", "string").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"), "number").when(kind == "BOOLEAN", "boolean")
    return out.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")


def violations(data: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """Array of messages: required fields that are missing, and fields of another type. fields: name -> (type, required)."""
    found = []
    for name, (kind, required) in fields.items():
        here = F.try_variant_get(F.try_parse_json(data), f"$.{name}", "variant")
        if required:
            found.append(F.when(here.isNull(), F.lit(f"missing field: {name}")))
        found.append(F.when(here.isNotNull() & ~_is(here, kind), F.lit(f"wrong type: {name}")))
    return F.array_compact(F.array(*found))


def _is(v: Column, kind: str) -> Column:
    name = F.schema_of_variant(v)
    patterns = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
    return F.coalesce(name.rlike(patterns[kind]), F.lit(False))


class Registry:
    """Schemas of custom facts by name prefix; a second version of a name is refused."""

    def __init__(self) -> None:
        self.schemas: dict[str, tuple[str, dict[str, tuple[str, bool]]]] = {}

    def register(self, name: str, version: str, fields: dict[str, tuple[str, bool]]) -> None:
        if name in self.schemas and self.schemas[name][0] != version:
            raise ValueError(f"{name} is registered in version {self.schemas[name][0]}")
        self.schemas[name] = (version, dict(fields))

    def unregister(self, name: str) -> bool:
        return self.schemas.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.schemas)

    def violations(self, discriminant: Column, data: Column) -> Column:
        out = F.array().cast("array<string>")
        for name in sorted(self.schemas, key=len):  # the longest prefix decides
            out = F.when(discriminant.startswith(name), violations(data, self.schemas[name][1])).otherwise(out)
        return out

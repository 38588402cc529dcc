"""Scalar reads from JSON text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Document:
    """A JSON text next to its parsed form, both given as SQL expressions.

    The text is parsed once per row, all wanted leaves as strings; the readers
    only pick fields.  A number read as text is printed shortest: 1.50 is "1.5".
    """

    def __init__(self, raw: str, parsed: str, strict: bool = False):
        self.raw = raw
        self.parsed = parsed
        self.strict = strict  # raise on malformed numbers instead of NULL

    def sql(self, path: str, kind: str = "string") -> str:
        """A scalar; NULL if absent, null, an object or an array."""
        value = f"{self.parsed}.{path}"
        # A string may look like an object: ask for the JSON type only then.
        found = f"try_variant_get(try_parse_json({self.raw}), '$.{path}', 'variant')"
        nested = f"schema_of_variant({found}) RLIKE '^(OBJECT|ARRAY)'"
        # Nested CASEs rather than AND, whose right side may be evaluated early.
        text = (
            f"CASE WHEN substr({value}, 1, 1) IN ('{{', '[')"
            f" THEN CASE WHEN {nested} THEN NULL ELSE {value} END ELSE {value} END"
        )
        if kind == "string":
            return text
        return f"{'cast' if self.strict else 'try_cast'}({text} AS {kind})"

    def struct_sql(self, fields: Iterable[tuple[str, str]], prefix: str = "") -> str:
        """A struct of (name, type) fields."""
        parts = [f"'{name}', {self.sql(prefix + name, kind)}" for name, kind in fields]
        return f"named_struct({', '.join(parts)})"

    def text(self, path: str) -> Column:
        return F.expr(self.sql(path))

    def number(self, path: str) -> Column:
        return F.expr(self.sql(path, "double"))

    def integer(self, path: str) -> Column:
        return F.expr(self.sql(path, "bigint"))


def text_fields(names: Iterable[str]) -> T.StructType:
    """Schema with every name as a string, once."""
    return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])

"""Events as JSON lines, with what is secret hidden at any depth.

What is hidden is decided by key: names of struct fields are known with the schema, so those are rewritten in the plan; keys of maps are looked at row by row. Values are
rewritten by expressions that are generated from the column's type, so there is no Python a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

MASK = "[REDACTED]"
#: Parts of names whose values are hidden, in either case.
FRAGMENTS = ("password", "passwd", "secret", "token", "api_key", "authorization")


def redact(value: Column, kind: DataType, fragments: tuple[str, ...] = FRAGMENTS) -> Column:
    """The value with a mask under every key that has one of the fragments, in structs, arrays and maps of any depth. Keys stay, nulls that aren't under such a key too.

    A masked field becomes a string. Values of maps of structs, arrays or numbers become variants, so that a masked one can stand among them.
    """
    pattern = re.compile("|".join(map(re.escape, fragments)), re.IGNORECASE)
    if isinstance(kind, StructType):
        fields = [(F.lit(MASK) if pattern.search(f.name) else redact(value[f.name], f.dataType, fragments)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redact(x, kind.elementType, fragments))
    if isinstance(kind, MapType):
        plain = isinstance(kind.valueType, StringType)
        mask = F.lit(MASK) if plain else F.parse_json(F.lit(f'"{MASK}"'))

        def shown(v: Column) -> Column:
            if plain:
                return v
            inner = redact(v, kind.valueType, fragments)
            return F.to_variant_object(inner) if isinstance(kind.valueType, (StructType, ArrayType, MapType)) else inner.cast("variant")

        return F.transform_values(value, lambda k, v: F.when(k.cast("string").rlike("(?i)" + pattern.pattern), mask).otherwise(shown(v)))
    return value


def redacted(events: DataFrame, *columns: str, fragments: tuple[str, ...] = FRAGMENTS) -> DataFrame:
    """Events with some columns rewritten by redact()."""
    return events.withColumns({c: redact(F.col(c), events.schema[c].dataType, fragments) for c in columns})


def append_events(events: DataFrame, path: str, data: str = "data") -> None:
    """Append events to a folder of JSON lines, a line an event; data is rewritten by redact()."""
    redacted(events, data).write.mode("append").option("ignoreNullFields", "false").json(path)

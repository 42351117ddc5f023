"""Canonical JSON: keys in order at every level, no spaces, nulls left out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*(ordered(column[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    return column


#: What canonical JSON writes in another way than Spark does: letters beyond ASCII, control characters, exponents.
OTHER = r"[^ -~]|\\u|[0-9]E-?[0-9]"


@F.pandas_udf(T.StringType())
def rewritten(texts: pd.Series) -> pd.Series:
    """The same JSON with escapes for all beyond printable ASCII and the shortest form of each number."""
    return texts.map(lambda t: None if t is None else json.dumps(json.loads(t), separators=(",", ":")))


def canonical_json(df: DataFrame) -> Column:
    """A row as canonical JSON: the bytes by which equal rows have equal digests everywhere."""
    text = F.to_json(F.struct(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))))
    odd = F.when(text.rlike(OTHER), text)
    return F.coalesce(rewritten(odd), text)

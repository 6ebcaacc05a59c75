"""Identities: canonical JSON digests, text digests, cache keys and name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(value: Column, kind: T.DataType) -> Column:
    """The same value with the fields of every struct in order of name."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType | T.ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON without spaces, keys in order, nulls kept."""
    return F.to_json(_sorted(value, kind), {"ignoreNullFields": "false"})


def canonical_sha256(value: Column, kind: T.DataType) -> Column:
    return F.sha2(canonical_json(value, kind), 256)


def text_sha256(value: Column | str) -> Column:
    return F.sha2(F.col(value) if isinstance(value, str) else value, 256)


def cache_key(*parts: Column) -> Column:
    """A key over parts of any content: lengths keep neighbouring parts apart."""
    pieces = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x.cast("string"), F.lit("")) for x in parts)]
    return F.sha2(F.concat(*pieces), 256)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of RFC 4122; namespace as 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble % 4 + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def scaled_hash(value: Column, low: float, high: float) -> Column:
    """A fixed score of a text: the first 8 bytes of its SHA-256 as a fraction of 2**64, scaled."""
    unit = F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))
    return F.lit(low) + unit * F.lit(high - low)

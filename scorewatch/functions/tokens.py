"""Deterministic opaque tokens and identities, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import as_col


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def segment_token(value: Column | str, namespace: str = "") -> Column:
    """``segment-`` + 24 hex digits of the namespaced label (null labels included)."""
    payload = F.to_json(
        F.struct(F.lit(namespace).alias("namespace"), as_col(value).alias("value")),
        {"ignoreNullFields": "false"},
    )
    return F.concat(F.lit("segment-"), short_hash(payload, 24))


def stable_token(value: Column | str, namespace: str = "value") -> Column:
    """``tok_`` + 16 hex digits of ``namespace:value``; null reads as ``None``."""
    text = F.coalesce(as_col(value).cast("string"), F.lit("None"))
    return F.concat(F.lit("tok_"), short_hash(F.concat(F.lit(f"{namespace}:"), text), 16))


def redaction_code(value: Column | str) -> Column:
    """``segment-`` + 8 hex digits, the display code of a hidden segment label."""
    return F.concat(F.lit("segment-"), short_hash(as_col(value), 8))


def redact_strings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Replace every text column (null stays null) by opaque tokens."""
    tokens: Mapping[str, Column] = {
        f.name: F.when(F.col(f.name).isNotNull(), stable_token(f.name))
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in keep
    }
    return df.withColumns(tokens) if tokens else df

"""Identities by content."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that a feature's group is named by.
GROUP_KEYS = ("window", "depth", "lags", "k", "price_col")


def canonical(value: Any) -> str:
    """The text that ids are digests of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def tags_text(tags: dict[str, Any]) -> str:
    """Tags as JSON with sorted keys, as catalogs hold them."""
    return json.dumps(tags, sort_keys=True)


def digest(value: Any, length: int) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:length]


def feature_id(source_table: str, source_key: str, family: str, transform: str, params: dict[str, Any], coord: str | None = None) -> str:
    # The names in the payload, of which the id is a digest.
    own = dict(coord=coord, family=family, params=params, source_key=source_key, source_table=source_table, transform=transform)
    return ".".join((family, transform, digest(own, 12))) + (f":{coord}" if coord else "")


def feature_id_column(source_table: str, source_key: Column, family: str, transform: str, params: dict[str, Any]) -> Column:
    """feature_id() of each row's source key, as an expression, for catalogs of any size. NULL keys give NULL. Keys are printable ASCII and white space; others raise in the job, since their JSON has escapes that only feature_id() makes."""
    mark = "\0"
    before, after = canonical(dict(coord=None, family=family, params=params, source_key=mark, source_table=source_table, transform=transform)).split(canonical(mark))
    key = source_key.cast("string")
    plain = F.when(key.rlike(r"^[\x08-\x0A\x0C\x0D\x20-\x7E]*\z"), key).when(key.isNotNull(), F.raise_error(F.concat(F.lit("not a printable ASCII key: "), key)))
    # As JSON text: the value of an object with one field.
    quoted = F.regexp_extract(F.to_json(F.struct(plain.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    whole = F.sha2(F.concat(F.lit(before), quoted, F.lit(after)), 256)
    return F.when(key.isNotNull(), F.concat(F.lit(f"{family}.{transform}."), F.substring(whole, 1, 12)))


def group_path(family: str, transform: str, params: dict[str, Any]) -> str:
    named = ",".join(f"{k}={v}" for k, v in sorted(params.items()) if k in GROUP_KEYS)
    return "/".join(p for p in (family, transform, named) if p)

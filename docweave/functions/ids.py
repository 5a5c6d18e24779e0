"""Hash keys and deterministic identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "docweave/points").hex


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(text: Column, provider: str, model: str, dim: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{provider}|{model}|{dim}|"), text), 256)


def point_id(source: Column, index: Column) -> Column:
    """Version 5 UUID of 'source:index' (RFC 9562): SHA-1 with version and variant overlaid."""
    name = F.encode(F.concat(source, F.lit(":"), index.cast("string")), "UTF-8")
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE)), name))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant.substr(nibble, F.lit(1)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def response_key(tier: Column, feature: Column, temperature: Column, messages: Column) -> Column:
    """Key of a cached reply: tier, feature, temperature and every 'role:content'."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return F.sha2(F.concat_ws("|", tier, feature, temperature.cast("string"), body), 256)

"""Identifiers, hashes, keys, signatures."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def key_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def key_prefix(raw: Column) -> Column:
    return F.substring(raw, 1, 10)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def direct_identity(sha256: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256)


def object_identity(key: Column, etag: Column) -> Column:
    return F.concat(F.lit("s3:"), key, F.lit(":"), F.coalesce(etag, F.lit("")))


def fingerprint(identity: Column, options: Sequence[Column]) -> Column:
    """Stable hash of audio identity and options: JSON of both, options in the given order."""
    named = F.struct(identity.alias("audio"), F.struct(*options).alias("options"))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def parse_object_key(key: Column, prefix: str) -> Column:
    """``struct<api_key_id, upload_id>`` of ``{prefix}{api_key_id}/{upload_id}``, or NULL unless
    both are canonical lower-case UUIDs."""
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in prefix)
    pattern = f"^{quoted}({_UUID})/({_UUID})$"
    whole = key.rlike(pattern) & ~F.endswith(key, F.lit("\n"))
    return F.when(
        whole,
        F.struct(
            F.regexp_extract(key, pattern, 1).alias("api_key_id"),
            F.regexp_extract(key, pattern, 2).alias("upload_id"),
        ),
    )


def canonical_uuid(text: Column) -> Column:
    """A job id of a message in canonical form, NULL if it is none. Upper case, braces, the URN
    prefix and missing dashes are accepted, as UUID parsers do."""
    bare = F.regexp_replace(text, "urn:|uuid:|-", "")
    bare = F.lower(F.regexp_replace(bare, r"^[{}]+|[{}]+\z", ""))
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    dashed = F.concat_ws("-", *[F.substring(bare, at, n) for at, n in parts])
    return F.when(bare.rlike(r"^[0-9a-f]{32}\z"), dashed)


def event_id(job_id: Column, status: Column) -> Column:
    """Name-based UUID (version 5) of ``status`` in the job's name space."""
    digest = F.sha1(
        F.concat(F.unhex(F.replace(job_id, F.lit("-"), F.lit(""))), F.encode(status, "utf-8"))
    )
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))
    )
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


@F.pandas_udf(T.StringType())
def hmac_hex(secret: pd.Series, stamp: pd.Series, body: pd.Series) -> pd.Series:
    """HMAC-SHA256 of ``stamp.body``; Spark has no keyed hash."""
    return pd.Series(
        [
            None
            if s is None or t is None or b is None
            else hmac.new(s.encode(), f"{t}.".encode() + b.encode(), hashlib.sha256).hexdigest()
            for s, t, b in zip(secret, stamp, body)
        ]
    )


def signature(secret: Column, stamp: Column, body: Column) -> Column:
    text = stamp.cast("string")
    return F.concat(F.lit("t="), text, F.lit(",v1="), hmac_hex(secret, text, body))


def signature_valid(
    secret: Column, body: Column, header: Column, now: Column, tolerance_s: int = 300
) -> Column:
    """Audit of a delivery's signature header: exactly one ``t``, any matching ``v1``, and a
    clock difference of at most ``tolerance_s``."""
    parts = F.transform(F.split(header, ","), lambda p: F.trim(p))
    well_formed = F.forall(parts, lambda p: F.contains(p, F.lit("=")))

    def values(name: str) -> Column:
        found = F.filter(parts, lambda p: F.startswith(p, F.lit(f"{name}=")))
        return F.transform(found, lambda p: F.substr(p, F.lit(len(name) + 2)))

    stamps, marks = values("t"), values("v1")
    stamp = F.try_element_at(stamps, F.lit(1))
    signed_at = F.trim(stamp).try_cast("bigint")
    fresh = F.abs(now - signed_at) <= tolerance_s
    expected = hmac_hex(secret, stamp, body)
    return F.coalesce(
        well_formed
        & (F.size(stamps) == 1)
        & (F.size(marks) > 0)
        & fresh
        & F.array_contains(marks, expected),
        F.lit(False),
    )


def request_id(header: Column) -> Column:
    """The caller's id if well formed, else a new one."""
    return F.when(
        F.coalesce(header.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False)), header
    ).otherwise(F.uuid())


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split(F.coalesce(header, F.lit("")), ";")[0]))


def short_error(message: Column) -> Column:
    return F.left(message, F.lit(500))


def stderr_tail(text: Column) -> Column:
    return F.right(text, F.lit(2000))

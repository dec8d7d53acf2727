"""Hashes and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def catalog_id(digest: Column, tenant: Column) -> Column:
    """The first 16 hex digits of the hash of a content hash followed by the tenant."""
    return F.substring(F.sha2(F.concat(digest, tenant).cast("binary"), 256), 1, 16)


def control_id(catalog: Column, identifier: Column) -> Column:
    return F.concat_ws("/", catalog, identifier)


def artifact_id(control: Column, name: Column, kind: Column) -> Column:
    """control__art_ and 8 hex digits of the hash of the normal name and the kind."""
    digest = F.sha2(F.concat_ws(":", name, kind).cast("binary"), 256)
    return F.concat(control, F.lit("__art_"), F.substring(digest, 1, 8))


def content_key(data: Column) -> Column:
    return F.concat(F.lit("attestation/"), content_hash(data), F.lit(".json"))


def job_key(job: Column, name: Column) -> Column:
    return F.concat(F.lit("jobs/"), job, F.lit("/attestation/"), name)


def report_hash(*columns: Column) -> Column:
    """The hash of a record's JSON; equal records have equal hashes."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def edge_id(*parts: Column) -> Column:
    """Deterministic, so that materialising twice adds nothing."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 24)

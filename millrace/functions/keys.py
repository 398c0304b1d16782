"""Artifact keys, names, labels and digests as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scheme of artifact addresses and the accepted name patterns.
SCHEME = "artifact://"
JOB_NAME = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\z"
PLAIN_FILE = r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"
DIGEST = r"^[a-z0-9]+:[0-9a-f]{32,}\z"
RESTART_SUFFIX = r"-r(\d+)\z"


def uri_to_key(uri: Column) -> Column:
    """Key of an artifact address; NULL when the scheme is another one."""
    return F.when(uri.startswith(SCHEME), F.substring(uri, len(SCHEME) + 1, 1 << 30))


def key_to_uri(key: Column) -> Column:
    return F.concat(F.lit(SCHEME), key)


def is_safe_key(key: Column) -> Column:
    """A relative key that cannot climb out of its folder."""
    return ~key.startswith("/") & ~F.array_contains(F.split(key, "/"), "..")


def delta_key(metrics_key: Column, file: Column) -> Column:
    """Sibling of ``metrics_key`` named ``file``; NULL unless it is a plain name."""
    return F.when(
        file.rlike(PLAIN_FILE),
        F.concat(F.regexp_replace(metrics_key, r"/[^/]*\z", ""), F.lit("/"), file),
    )


def commit_key(job_id: Column, task_id: Column) -> Column:
    return F.concat(F.lit("jobs/"), job_id, F.lit("/"), task_id, F.lit("/metrics.json"))


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(DIGEST), F.lit(False))


def keep_labels(labels: Column, prefixes: Sequence[str]) -> Column:
    """Entries of a map whose key starts with an allowed prefix."""

    def allowed(k: Column, _: Column) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | k.startswith(p)
        return hit

    return F.map_filter(labels, allowed)


def is_restart(attempt_id: Column) -> Column:
    return F.coalesce(attempt_id.rlike(RESTART_SUFFIX), F.lit(False))


def fill(template: Column, params: Column) -> Column:
    """Replace every ``{name}`` from a map; NULL if a placeholder has no value.

    ``{{`` and ``}}`` stand for literal braces.
    """
    opened = F.regexp_replace(F.regexp_replace(template, r"\{\{", "\u0001"), r"\}\}", "\u0002")
    filled = F.aggregate(
        F.map_entries(params),
        opened,
        lambda text, kv: F.replace(text, F.concat(F.lit("{"), kv["key"], F.lit("}")), kv["value"]),
    )
    missing = F.exists(
        F.regexp_extract_all(opened, F.lit(r"\{([^{}]*)\}"), F.lit(1)),
        lambda name: ~F.coalesce(F.array_contains(F.map_keys(params), name), F.lit(False)),
    ) | F.regexp_replace(opened, r"\{[^{}]*\}", "").rlike(r"[{}]")
    return F.when(
        ~missing,
        F.regexp_replace(F.regexp_replace(filled, "\u0001", "{"), "\u0002", "}"),
    )


def digest(*columns: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a record's JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def model_key(name: Column) -> Column:
    """Catalog key of a model name: last path part, lower case, no role suffix.

    Suffixes are removed once each, in this fixed order.
    """
    tail = F.element_at(F.split(F.lower(F.trim(name)), "/"), -1)
    for suffix in ("-instruct", "-chat", "-base", "-hf"):
        tail = F.regexp_replace(tail, suffix + r"\z", "")
    return tail

"""Cleaning of self-reported measurements and status fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.vectors import finite

# Cell texts that mean "no value", and the longest lease.
PLACEHOLDERS = ["", "n/a", "[n/a]", "not supported", "[not supported]", "unknown", "[unknown]"]
MAX_LEASE_SECONDS = 3600.0


def reading(v: Column) -> Column:
    """A VARIANT probe answer as a number; booleans, text, NaN and infinities are NULL."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    numeric = kind.rlike(r"^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    x = F.when(numeric, F.try_variant_get(v, "$", "double"))
    return F.when(finite(x), x)


def percent(v: Column) -> Column:
    """As :func:`reading`, and NULL outside 0..100: that is a misparse."""
    x = reading(v)
    return F.when(x.between(0.0, 100.0), x)


def number_or_null(x: Column) -> Column:
    """A DOUBLE column without NaN and infinities."""
    return F.when(finite(x), x)


def cell(text: Column) -> Column:
    """Trimmed text, or the empty text for a placeholder."""
    t = F.trim(text)
    return F.when(F.lower(t).isin(PLACEHOLDERS), F.lit("")).otherwise(F.coalesce(t, F.lit("")))


def cpu_cores(quantity: Column) -> Column:
    """Cores from ``2`` or ``500m``."""
    milli = F.regexp_extract(quantity, r"^(.*)m\z", 1)
    return F.when(quantity.endswith("m"), milli.try_cast("double") / 1000.0).otherwise(
        quantity.try_cast("double")
    )


def memory_bytes(quantity: Column) -> Column:
    """Bytes from ``1024``, ``512Mi``, ``2G`` and the like; fractions are cut."""
    # Suffix and multiplier.
    units = [
        ("Ki", 1024),
        ("Mi", 1024**2),
        ("Gi", 1024**3),
        ("Ti", 1024**4),
        ("K", 1000),
        ("M", 1000**2),
        ("G", 1000**3),
        ("T", 1000**4),
    ]
    out = None
    for suffix, factor in units:
        number = F.substring(quantity, F.lit(1), F.length(quantity) - len(suffix)).try_cast("double")
        value = (number * F.lit(float(factor))).cast("bigint")
        hit = quantity.endswith(suffix)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(quantity.try_cast("bigint"))


def clean_lease_seconds(v: Column, default: float) -> Column:
    """Lease length from a VARIANT: the default when absent, NULL when unusable (not a
    number, not finite, not above zero), never longer than an hour."""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    x = F.when(kind == "VOID", F.lit(float(default))).when(
        kind != "BOOLEAN", F.try_variant_get(v, "$", "double")
    )
    usable = finite(x) & (x > 0)
    return F.when(usable, F.least(x, F.lit(MAX_LEASE_SECONDS)))


def valid_metrics(v: Column) -> Column:
    """Task output must be an object."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")


def external_job_state(deployment: Column, job: Column) -> Column:
    """One state from the two axes of a cluster operator; the job's own wins."""
    d, j = F.coalesce(deployment, F.lit("")), F.coalesce(job, F.lit(""))
    return (
        F.when(j == "SUCCEEDED", "SUCCEEDED")
        .when((j == "FAILED") | (d == "Failed"), "FAILED")
        .when(j == "STOPPED", "CANCELLED")
        .when(j == "RUNNING", "RUNNING")
        .when(j == "PENDING", "SUBMITTED")
        .when(d == "Running", "RUNNING")
        .when(d == "Complete", "SUCCEEDED")
        .otherwise("SUBMITTED")
    )

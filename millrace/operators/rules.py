"""Row checks that report every problem instead of stopping at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import JOB_NAME, SCHEME


def _collect(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def _bad(condition: Column, text: str) -> Column:
    """The problem's text unless the condition is known to hold."""
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(text))


def validate_jobs(jobs: DataFrame) -> DataFrame:
    """Add ``problems``: all rules a job description breaks (empty when sound).

    Columns: ``name, image_tag, minimum_workers, maximum_workers, output_prefix,
    max_task_attempts``.
    """
    c = F.col
    return jobs.withColumn(
        "problems",
        _collect(
            _bad(c("name").rlike(JOB_NAME), "name is not a DNS-1123 label"),
            _bad((c("image_tag") != "latest") & (c("image_tag") != ""), "image tag is not pinned"),
            _bad(c("minimum_workers") >= 1, "minimum workers below one"),
            _bad(c("maximum_workers") >= 1, "maximum workers below one"),
            F.when(
                c("maximum_workers") < c("minimum_workers"),
                F.lit("maximum workers below minimum workers"),
            ),
            _bad(c("output_prefix").startswith(SCHEME), "output prefix has another scheme"),
            _bad(c("max_task_attempts") >= 1, "attempts below one"),
        ),
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _list_of(v: Column, test) -> Column:
    return _kind(v).startswith("ARRAY") & F.forall(_items(v), test)


def duplicates(names: Column) -> Column:
    """Names listed more than once, sorted."""
    return F.array_sort(
        F.filter(
            F.array_distinct(names),
            lambda n: F.size(F.filter(names, lambda m: m == n)) > 1,
        )
    )


def undeclared(names: Column, declared: Column) -> Column:
    """Names that are used but not declared, sorted."""
    return F.array_sort(F.array_except(names, declared))


def validate_commands(df: DataFrame, column: str = "parameters") -> DataFrame:
    """Add ``problems`` for a VARIANT of command parameters: ``command``, ``inputs``,
    ``task_params`` and ``unpack_inputs``."""
    get = lambda path: F.try_variant_get(column, "$." + path, "variant")
    text = lambda x: _kind(x) == "STRING"
    obj = lambda x: _kind(x).startswith("OBJECT")
    command, params, unpack = get("command"), get("task_params"), get("unpack_inputs")
    inputs = F.coalesce(
        F.try_variant_get(column, "$.inputs", "map<string,variant>"),
        F.create_map().cast("map<string,variant>"),
    )
    names = F.when(
        _list_of(unpack, text),
        F.coalesce(F.try_variant_get(unpack, "$", "array<string>"), F.array().cast("array<string>")),
    ).otherwise(F.array().cast("array<string>"))
    address = lambda v: F.coalesce(
        text(v) & F.try_variant_get(v, "$", "string").startswith(SCHEME), F.lit(False)
    )
    bad_inputs = F.transform(
        F.filter(F.map_entries(inputs), lambda e: ~address(e["value"])),
        lambda e: F.concat(F.lit("input '"), e["key"], F.lit("' is not an artifact address")),
    )
    joined = lambda a: F.array_join(a, ", ")
    twice, unknown = duplicates(names), undeclared(names, F.map_keys(inputs))
    rest = _collect(
        F.when(
            (_kind(params) != "VOID") & ~_list_of(params, obj),
            F.lit("task_params is not a list of objects"),
        ),
        F.when(
            (_kind(unpack) != "VOID") & ~_list_of(unpack, text),
            F.lit("unpack_inputs is not a list of names"),
        ),
        F.when(F.size(twice) > 0, F.concat(F.lit("unpacked more than once: "), joined(twice))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unpacked but not declared: "), joined(unknown))),
    )
    first = _collect(
        F.when(
            ~(_list_of(command, text) & (F.size(_items(command)) > 0)),
            F.lit("command is not a non-empty list of texts"),
        )
    )
    return df.withColumn("problems", F.concat(first, bad_inputs, rest))


def valid_outputs(attempts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Add ``output_valid``: the artifact at ``commit_key`` exists with the claimed hash.

    ``artifacts``: ``key, sha256``, one row per key.
    """
    stored = artifacts.select(F.col("key").alias("commit_key"), F.col("sha256").alias("_stored"))
    return (
        attempts.join(stored, "commit_key", "left")
        .withColumn(
            "output_valid", F.coalesce(F.col("_stored") == F.col("output_sha256"), F.lit(False))
        )
        .drop("_stored")
    )

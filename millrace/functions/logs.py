"""Failure evidence from log text and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exception names that recur on every retry, and the log markers.
DETERMINISTIC_ERRORS = [
    "SyntaxError",
    "IndentationError",
    "ImportError",
    "ModuleNotFoundError",
    "NameError",
    "AttributeError",
]
TRACEBACK = "Traceback (most recent call last):"
ELASTIC_WRAPPER = "ChildFailedError"
COMMUNICATION_MARKERS = [
    "nccl",
    "rccl",
    "gloo",
    "rendezvous",
    "allreduce",
    "all_reduce",
    "process group",
]
STORAGE_MARKERS = ["s3", "oss", "minio", "object store", "storage timeout", "slowdown"]
#: Failures in one window that make a single incident of them.
CORRELATED_THRESHOLD = 3

#: An error name counts only where a traceback ends: at a line's start, bare or
#: with a message, optionally after its module path. (?d): only \n ends a line.
_TERMINAL_LINE = r"(?Udm)^(?:\w+\.)*(?:" + "|".join(DETERMINISTIC_ERRORS) + r")(?::|$)"


def is_deterministic(exit_code: Column, log: Column) -> Column:
    """True when a retry would fail the same way. A clean or absent exit code never is."""
    text = F.coalesce(log, F.lit(""))
    failed = F.coalesce(exit_code != 0, F.lit(False))
    bare_traceback = text.contains(TRACEBACK) & ~text.contains(ELASTIC_WRAPPER)
    return failed & (text.rlike(_TERMINAL_LINE) | bare_traceback)


def log_signals(exit_code: Column, log: Column) -> Column:
    return F.struct(
        exit_code.alias("exit_code"),
        is_deterministic(exit_code, log).alias("exit_deterministic"),
    )


def _has_marker(message: Column, markers: list[str], whole_words: bool) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    if whole_words:
        return text.rlike(r"\b(?:" + "|".join(markers) + r")\b")
    hit = F.lit(False)
    for m in markers:
        hit = hit | text.contains(m)
    return hit


def has_comm_marker(message: Column) -> Column:
    return _has_marker(message, COMMUNICATION_MARKERS, False)


def has_storage_marker(message: Column, whole_words: bool = False) -> Column:
    """Plain substrings by default, so "loss" contains ``oss``; ``whole_words``
    asks for the marker on its own."""
    return _has_marker(message, STORAGE_MARKERS, whole_words)


def failure_class(signal) -> Column:
    """Class of a failure by precedence: systemic, node, process, application.

    ``signal(name, default)`` returns the Column of a piece of evidence.
    """
    false = F.lit(False)
    flag = lambda name: F.coalesce(signal(name, false), false)
    number = lambda name, d: F.coalesce(signal(name, F.lit(d)), F.lit(d))
    message = signal("message", F.lit(""))
    exit_code = signal("exit_code", F.lit(None).cast("int"))
    return (
        F.when(number("concurrent_failures", 1) >= CORRELATED_THRESHOLD, "correlated_incident")
        .when(flag("control_plane_unreachable"), "control_plane_failure")
        .when(flag("preemption_notice"), "preemption")
        .when(flag("xid_event") | flag("driver_fault"), "accelerator_failure")
        .when(flag("heartbeat_lost") | flag("node_unreachable"), "node_loss")
        .when(has_comm_marker(message), "communication_error")
        .when(
            (number("storage_errors", 0) > 0) | has_storage_marker(message), "storage_timeout"
        )
        .when(flag("hash_mismatch") | flag("validation_failed"), "artifact_corruption")
        .when(
            F.coalesce(exit_code != 0, false),
            F.when(flag("exit_deterministic"), "application_error").otherwise("worker_crash"),
        )
        .otherwise("unknown")
    )

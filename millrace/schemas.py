"""Record layouts and closed value lists."""

from __future__ import annotations

# The names records use.
JOB_STATES = ["PENDING", "SUBMITTED", "RUNNING", "RECOVERING", "SUCCEEDED", "FAILED", "CANCELLED"]
TERMINAL_JOB_STATES = ["SUCCEEDED", "FAILED", "CANCELLED"]
TASK_STATES = ["PENDING", "LEASED", "COMPLETED", "FAILED", "CANCELLED"]
ATTEMPT_OUTCOMES = ["running", "committed", "rejected", "failed", "expired"]
EVENT_TYPES = [
    "JOB_ACCEPTED",
    "BACKEND_SELECTED",
    "RAYJOB_CREATED",
    "RAY_CLUSTER_STARTING",
    "NODE_REGISTERED",
    "NODE_READY",
    "TASK_ATTEMPT_STARTED",
    "TASK_ATTEMPT_COMPLETED",
    "NODE_HEARTBEAT_LOST",
    "RAY_WORKER_LOST",
    "TASK_ATTEMPT_RETRIED",
    "RAY_WORKER_REPLACED",
    "ITERATION_COMPLETED",
    "ARTIFACT_UPLOAD_STARTED",
    "ARTIFACT_COMMITTED",
    "JOB_SUCCEEDED",
    "JOB_FAILED",
    "TASK_CREATED",
    "LEASE_CLAIMED",
    "LEASE_RENEWED",
    "LEASE_EXPIRED",
    "TASK_REQUEUED",
    "TASK_COMMIT_ACCEPTED",
    "TASK_COMMIT_REJECTED",
    "TASK_ATTEMPT_FAILED",
    "TASK_EXHAUSTED",
    "CHECKPOINT_PARTS_REGISTERED",
    "CHECKPOINT_MANIFEST_COMMITTED",
    "CHECKPOINT_RESTORE_VERIFIED",
    "CHECKPOINT_REJECTED",
    "FAILURE_CLASSIFIED",
    "RECOVERY_ACTION_SELECTED",
    "RECOVERY_FROZEN",
]
#: Types this library adds: a commit before it is judged, and a withdrawal.
REQUEST_TYPES = ["COMMIT_OFFERED", "TASK_CANCELLED"]

LEDGER = (
    "seq bigint, job_id string, task_id string, node_id string, lease_id string, "
    "type string, ts timestamp, output_valid boolean"
)
TASKS = "job_id string, task_id string, max_attempts int, lease_seconds double"
CONTRIBUTIONS = (
    "round int, position int, task_id string, samples bigint, loss double, "
    "param string, shape array<int>, data array<double>"
)
PARTS = (
    "job_id string, attempt_id string, step bigint, key string, sha256 string, "
    "size_bytes bigint, seq bigint"
)
MANIFESTS = (
    "manifest_id string, job_id string, attempt_id string, step bigint, world_size int, "
    "compatible_world_sizes array<int>, storage_prefix string, validation string, "
    "created timestamp"
)
MANIFEST_DOCUMENT = (
    "manifest_id string, job_id string, attempt_id string, step bigint, framework string, "
    "world_size int, compatible_world_sizes array<int>, storage_prefix string, "
    "parts array<struct<key:string,sha256:string,size_bytes:bigint>>, validation string, "
    "created timestamp"
)
RUN_DOCUMENT = (
    "contract string, state string, started_at double, finished_at double, max_restarts int, "
    "attempts array<struct<attempt_id:string,job_id:string,state:string,pid:string,"
    "started_at:double,finished_at:double,output_dir:string>>, "
    "events array<struct<ts:double,type:string,message:string>>, trials array<map<string,string>>"
)
TELEMETRY = (
    "attempt_id string, ts double, machine struct<hostname:string,cpu_count:int,"
    "cpu_percent:double,mem_total:bigint,mem_used:bigint,limited:boolean,"
    "gpus:array<struct<name:string,util_percent:double,mem_used_mb:double,mem_total_mb:double>>>, "
    "processes array<struct<pid:int,ppid:int,cmd:string,cpu_percent:double,rss_bytes:bigint>>"
)
RANKS = (
    "attempt_id string, rank int, local_rank int, pid int, device string, backend string, "
    "world_size int, step bigint, ts double"
)
METRICS = "attempt_id string, line bigint, values map<string,double>"

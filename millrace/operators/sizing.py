"""Capacity sizing over a table of requests.

One row per request goes in; candidates (strategy and world size) are exploded
from the row itself, so nothing is joined but the fixed catalogs. Figures are
static estimates in GB of 1e9 bytes, minutes and dollars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.keys import digest, model_key

# Published model sizes: billions of parameters, hidden size, layers.
MODELS = [
    ("qwen2.5-0.5b", 0.49, 896, 24),
    ("qwen2.5-1.5b", 1.54, 1536, 28),
    ("qwen2.5-3b", 3.09, 2048, 36),
    ("qwen2.5-7b", 7.62, 3584, 28),
    ("qwen2.5-14b", 14.7, 5120, 48),
    ("qwen2.5-32b", 32.8, 5120, 64),
    ("qwen2.5-72b", 72.7, 8192, 80),
    ("llama-3.1-8b", 8.03, 4096, 32),
    ("llama-3.1-70b", 70.6, 8192, 80),
    ("llama-3.2-1b", 1.24, 2048, 16),
    ("llama-3.2-3b", 3.21, 3072, 28),
    ("mistral-7b", 7.25, 4096, 32),
    ("gemma-2-9b", 9.24, 3584, 42),
    ("gpt2", 0.124, 768, 12),
]

# GPU memory in GB and dense bf16 TFLOPs.
GPUS = [
    ("h100", 80.0, 700.0),
    ("a100-80gb", 80.0, 312.0),
    ("a100-40gb", 40.0, 312.0),
    ("a100", 40.0, 312.0),
    ("l40s", 48.0, 362.0),
    ("rtx4090", 24.0, 165.0),
    ("rtx3090", 24.0, 71.0),
    ("a10", 24.0, 125.0),
    ("l4", 24.0, 121.0),
    ("v100", 16.0, 112.0),
    ("t4", 16.0, 65.0),
]

# Effective link bandwidth in GB/s and latency in seconds.
LINKS = [
    ("same_host_nvlink", 250.0, 0.00001),
    ("same_host_pcie", 20.0, 0.00002),
    ("multi_node_ib", 25.0, 0.00005),
    ("multi_node_100g", 10.0, 0.0001),
    ("multi_node_10g", 1.1, 0.0003),
    ("wan", 0.05, 0.03),
]

# Largest size of a class in billions, hidden size, layers.
SHAPES = [
    (0.2, 768, 12),
    (0.7, 1024, 24),
    (2.0, 2048, 24),
    (4.0, 3072, 28),
    (9.0, 4096, 32),
    (16.0, 5120, 40),
    (40.0, 6656, 60),
    (90.0, 8192, 80),
]
LARGEST_SHAPE = (12288, 96)

# Bytes, factors and limits of the estimates.
PRECISION_BYTES = {"bf16": 2.0, "fp16": 2.0, "fp32": 4.0}
OPTIMIZER_BYTES = {"adamw": 12.0, "adamw_8bit": 6.0, "sgd_momentum": 8.0}
FROZEN_4BIT_BYTES = 0.55
ACTIVATION_BYTES = 18.0
OVERHEAD_GB = 2.5
GB = 1e9
AUTO_FRACTION = 0.80
HARD_FRACTION = 0.95
HOST_RAM_FRACTION = 0.8
MFU = 0.30
OVERLAP = 0.5
REJECT_BELOW = 0.5
WARN_BELOW = 0.7
CHECKPOINTING_PENALTY = 1.30
QUANTIZED_PENALTY = 1.35
OFFLOAD_PENALTY = 4.0
DEFAULT_ACTIVATION_GB = 2.0
GENERIC_LAYERS = 32
STATUS_ORDER = ["selected", "feasible", "rejected_policy", "rejected_dominated", "infeasible"]


def catalogs(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    models = spark.createDataFrame(
        MODELS,
        "model_key string, cat_params_b double, cat_hidden int, cat_layers int",
    )
    gpus = spark.createDataFrame(
        GPUS, "gpu_key string, cat_vram_gb double, tflops double"
    )
    links = spark.createDataFrame(
        LINKS, "link string, link_gbps double, link_latency_s double"
    )
    return models, gpus, links


def shape_for(params_b: Column, field: int) -> Column:
    """Hidden size (``field`` 1) or layers (2) of the first class that is large enough;
    NULL for an unknown size."""
    out = F.when(params_b.isNull(), F.lit(None).cast("int"))
    for row in SHAPES:
        out = out.when(params_b <= row[0], row[field])
    return out.otherwise(LARGEST_SHAPE[field - 1])


def _pick(column: Column, table: dict[str, float]) -> Column:
    out = None
    for key, value in table.items():
        hit = column == key
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


# -- resolve ------------------------------------------------------------------


def resolve(requests: DataFrame) -> DataFrame:
    """Fill size, shape and GPU figures; ``problem`` names what cannot be resolved.

    A figure stated in the request wins over the catalog, the catalog over the
    size class. The catalogs are constants, hence broadcast.
    """
    models, gpus, _ = catalogs(requests.sparkSession)
    joined = (
        requests.withColumn("model_key", model_key(F.col("model")))
        .withColumn("gpu_key", F.lower(F.trim("gpu_type")))
        .join(F.broadcast(models), "model_key", "left")
        .join(F.broadcast(gpus), "gpu_key", "left")
        .withColumn("params_b", F.coalesce("parameters_b", "cat_params_b"))
        .withColumn("vram", F.coalesce("vram_gb", "cat_vram_gb"))
    )
    both = F.coalesce((F.col("hidden_size") > 0) & (F.col("num_layers") > 0), F.lit(False))
    shape = lambda given, listed, field: (
        F.when(both, F.col(given))
        .when(F.col(listed).isNotNull(), F.col(listed))
        .otherwise(shape_for(F.col("params_b"), field))
    )
    training = F.col("kind").isin("transformer_finetune", "pytorch_training")
    gpu_tasks = (
        (F.col("kind") == "independent_tasks")
        & F.col("needs_gpu")
        & (F.col("gpus") > 0)
        & (F.col("vram_gb_per_task") > 0)
    )
    return (
        joined.withColumn("hidden", shape("hidden_size", "cat_hidden", 1))
        .withColumn("layers", shape("num_layers", "cat_layers", 2))
        .withColumn("shape_derived", ~both & F.col("cat_hidden").isNull())
        .withColumn("tflops", F.coalesce("tflops", F.lit(0.0)))
        .withColumn(
            "problem",
            F.when(
                (F.col("kind") == "transformer_finetune") & F.col("params_b").isNull(),
                "model size unknown",
            )
            .when((training | F.coalesce(gpu_tasks, F.lit(False))) & F.col("vram").isNull(), "GPU memory unknown")
            .when(training & (F.col("gpus") < 1), "needs a GPU"),
        )
    )


# -- candidates ---------------------------------------------------------------


def world_sizes(gpus: Column) -> Column:
    """1, the powers of two below the count, and the count itself."""
    powers = F.array(*[F.lit(2**i) for i in range(1, 31)])
    return F.array_sort(
        F.array_distinct(
            F.concat(F.array(F.lit(1)), F.filter(powers, lambda p: p < gpus), F.array(gpus))
        )
    )


def _families(kind: str) -> Column:
    spread = ["ddp", "fsdp2", "zero3_cpu_offload"] if kind == "transformer" else ["ddp", "fsdp2"]
    return F.when(F.col("world") == 1, F.array(F.lit("single_gpu"))).otherwise(
        F.array(*[F.lit(f) for f in spread])
    )


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """Position inside the request's own menu, computed from the row."""
    return df.withColumn("position", F.struct(*order))


def training_candidates(resolved: DataFrame, kind: str) -> DataFrame:
    """Every (method, world size, family) worth estimating for training requests."""
    name = "transformer_finetune" if kind == "transformer" else "pytorch_training"
    rows = resolved.filter((F.col("kind") == name) & F.col("problem").isNull())
    if kind == "transformer":
        methods = F.when(
            (F.col("method") == "lora") & F.col("allow_quantization"),
            F.array(F.lit("lora"), F.lit("qlora")),
        ).otherwise(F.array("method"))
        rows = rows.withColumn("_m", methods).select(
            "*", F.posexplode("_m").alias("variant", "used_method")
        )
    else:
        rows = rows.withColumn("variant", F.lit(0)).withColumn("used_method", F.lit("full"))
    rows = rows.withColumn("world", F.explode(world_sizes(F.col("gpus"))))
    rows = rows.select("*", F.posexplode(_families(kind)).alias("family_no", "family"))
    if kind == "transformer":
        rows = rows.filter(
            (F.col("allow_cpu_offload") | (F.col("family") != "zero3_cpu_offload"))
            & ~((F.col("family") == "fsdp2") & (F.col("used_method") == "qlora"))
        )
    return _numbered(rows, "variant", "world", "family_no")


# -- memory -------------------------------------------------------------------


def _gb(x: Column) -> Column:
    return F.round(x / GB, 2)


def transformer_memory(df: DataFrame) -> DataFrame:
    """Per-GPU memory by component, without (``total_gb``) and with
    (``total_ckpt_gb``) activation checkpointing."""
    c = F.col
    sharded = c("family").isin("fsdp2", "zero3_cpu_offload")
    offloaded = c("family") == "zero3_cpu_offload"
    df = df.withColumns(
        {
            "params": c("params_b") * 1e9,
            "precision_bytes": _pick(c("precision"), PRECISION_BYTES),
            "_optimizer_bytes": _pick(c("optimizer"), OPTIMIZER_BYTES),
            "_share": F.when(sharded, F.greatest(F.lit(1), c("world"))).otherwise(1),
            "_slab": c("seq_len").cast("double") * c("micro_batch") * c("hidden"),
            "_full": c("used_method") == "full",
        }
    )
    adapters = 8.0 * c("hidden") * c("lora_rank") * c("layers")
    df = df.withColumn("trainable", F.when(c("_full"), c("params")).otherwise(adapters))
    frozen = F.when(c("used_method") == "qlora", FROZEN_4BIT_BYTES).otherwise(c("precision_bytes"))
    tuned = c("trainable") * c("precision_bytes")
    held = F.when(c("_full"), tuned).otherwise(c("params") * frozen + tuned)
    df = df.withColumns(
        {
            "_w": held / c("_share"),
            "_g": tuned / c("_share"),
            "_states": c("trainable") * c("_optimizer_bytes") / c("_share"),
            # Whole layers are gathered one at a time while they are computed.
            "_t": F.when(sharded, c("params") / c("layers") * c("precision_bytes") * 2.0).otherwise(0.0),
        }
    )
    df = df.withColumns(
        {
            "_off": F.when(offloaded, c("_states")).otherwise(0.0),
            "_fixed": c("_w") + c("_g") + F.when(offloaded, 0.0).otherwise(c("_states")) + c("_t")
            + OVERHEAD_GB * GB,
        }
    )
    per_layer = c("_slab") * ACTIVATION_BYTES
    recomputed = c("layers") * c("_slab") * 2.0 + per_layer
    return df.withColumns(
        {
            "total_gb": _gb(c("_fixed") + c("layers") * per_layer),
            "total_ckpt_gb": _gb(c("_fixed") + recomputed),
        }
    )


def generic_memory(df: DataFrame) -> DataFrame:
    """The same components for other networks, with activations as stated."""
    c = F.col
    activation = F.coalesce(
        F.when(c("activation_gb") != 0, c("activation_gb")), F.lit(DEFAULT_ACTIVATION_GB)
    )
    df = df.withColumns(
        {
            "params": c("parameters_m") * 1e6,
            "precision_bytes": _pick(c("precision"), PRECISION_BYTES),
            "_optimizer_bytes": _pick(c("optimizer"), OPTIMIZER_BYTES),
            "_share": F.when(c("family") == "fsdp2", F.greatest(F.lit(1), c("world"))).otherwise(1),
        }
    ).withColumn("trainable", c("params") * c("trainable_fraction"))
    states = c("trainable") * (c("precision_bytes") + c("_optimizer_bytes"))
    weights = c("params") * c("precision_bytes")
    total = (weights + states) / c("_share") + (activation + OVERHEAD_GB) * GB
    return df.withColumn("total_gb", _gb(total))


# -- link, time, cost ---------------------------------------------------------


def effective_link(df: DataFrame) -> DataFrame:
    """Add ``link`` and its figures: a group that fits one host uses the host's link."""
    per_host = F.greatest(F.lit(1), F.floor(F.col("gpus") / F.col("hosts")))
    local = (F.col("hosts") == 1) | (F.col("world") <= per_host)
    own = F.when(
        F.col("interconnect").startswith("same_host"), F.col("interconnect")
    ).otherwise("same_host_pcie")
    _, _, links = catalogs(df.sparkSession)
    return df.withColumn("link", F.when(local, own).otherwise(F.col("interconnect"))).join(
        F.broadcast(links), "link", "left"
    )


def link_efficiency(df: DataFrame, layers: Column) -> DataFrame:
    """Add ``efficiency`` and ``link_ok`` from ``compute_s`` (0 when unknown: then only
    the slowest class of link is refused)."""
    c = F.col
    ring = c("family").isin("ddp", "single_gpu")
    others = (c("world") - 1) / c("world")
    sent = F.when(ring, 2.0 * c("trainable")).otherwise(3.0 * c("params"))
    rounds = F.when(ring, F.lit(1.0)).otherwise(3.0 * layers)
    wire = others * sent * c("precision_bytes") / (c("link_gbps") * GB) + rounds * c("link_latency_s")
    df = df.withColumn("_exposed", F.greatest(F.lit(0.0), wire - OVERLAP * c("compute_s")))
    unknown = c("compute_s") <= 0
    e = (
        F.when(c("world") <= 1, 1.0)
        .when(unknown, F.when(c("link") == "wan", 0.0).otherwise(1.0))
        .otherwise(c("compute_s") / (c("compute_s") + c("_exposed")))
    )
    df = df.withColumn("_e", e)
    floor = F.when((c("world") <= 1) | unknown, c("_e") > 0).otherwise(c("_e") >= REJECT_BELOW)
    return (
        df.withColumns({"link_ok": floor, "efficiency": F.round("_e", 2)})
        .withColumn("link_wasteful", c("link_ok") & (c("_e") < WARN_BELOW))
        .drop("_e", "_exposed")
    )


def tokens_per_second(params: Column, tflops: Column) -> Column:
    return F.when((tflops > 0) & (params > 0), MFU * tflops * 1e12 / (6.0 * params)).otherwise(0.0)


def cost_usd(minutes: Column, world: Column, hourly: Column) -> Column:
    return F.round(minutes / 60.0 * F.greatest(F.lit(1), world) * hourly, 2)


def _policy_status(df: DataFrame) -> Column:
    late = (F.col("deadline_minutes") > 0) & (F.col("est_time_min") > F.col("deadline_minutes"))
    dear = (F.col("max_cost_usd") > 0) & (F.col("est_cost_usd") > F.col("max_cost_usd"))
    return F.when(
        F.coalesce(late, F.lit(False)) | F.coalesce(dear, F.lit(False)), "rejected_policy"
    ).otherwise("feasible")


OUTPUT = [
    "request_id",
    "name",
    "strategy_family",
    "workers",
    "status",
    "total_gb",
    "offload_gb",
    "efficiency",
    "est_time_min",
    "est_cost_usd",
    "profiling_required",
    "vram_deficit_gb",
    "headroom_gb",
    "quantized",
    "position",
    "mode",
    "allow_quantization",
    "allow_cpu_offload",
]


def evaluate_transformer(resolved: DataFrame) -> DataFrame:
    df = transformer_memory(training_candidates(resolved, "transformer"))
    cap = F.col("vram") * HARD_FRACTION
    asked = F.col("activation_checkpointing")
    first = F.when(F.coalesce(asked, F.lit(False)), F.col("total_ckpt_gb")).otherwise(F.col("total_gb"))
    rescued = asked.isNull() & (F.col("total_gb") > cap) & (F.col("total_ckpt_gb") <= cap)
    df = df.withColumn("_auto", rescued).withColumn(
        "act_ckpt", F.col("_auto") | F.coalesce(asked, F.lit(False))
    )
    df = df.withColumn("total_gb", F.when(F.col("_auto"), F.col("total_ckpt_gb")).otherwise(first))
    df = effective_link(df)
    df = df.withColumn("_tps", tokens_per_second(F.col("params"), F.col("tflops")))
    tps = F.col("_tps")
    micro = F.when(tps > 0, F.col("seq_len") * F.col("micro_batch") / tps).otherwise(0.0)
    ring = F.col("family").isin("ddp", "single_gpu")
    df = df.withColumn("compute_s", F.when(ring, micro * F.col("grad_accum")).otherwise(micro))
    df = link_efficiency(df, F.col("layers"))
    df = df.withColumns(
        {"_deficit": F.greatest(F.lit(0.0), F.col("total_gb") - cap), "_off_gb": _gb(F.col("_off"))}
    )
    df = df.withColumn(
        "_fits",
        (F.col("_deficit") <= 0) & (F.col("_off_gb") <= F.col("cpu_ram_gb") * HOST_RAM_FRACTION),
    ).withColumn("_usable", F.col("_fits") & F.col("link_ok"))
    deficit, offload_gb = F.col("_deficit"), F.col("_off_gb")
    fits, usable = F.col("_fits"), F.col("_usable")
    quantized = F.col("used_method") == "qlora"
    penalty = (
        F.when(F.col("act_ckpt"), CHECKPOINTING_PENALTY).otherwise(1.0)
        * F.when(quantized, QUANTIZED_PENALTY).otherwise(1.0)
        * F.when(F.col("family") == "zero3_cpu_offload", OFFLOAD_PENALTY).otherwise(1.0)
    )
    fleet = tps * F.greatest(F.lit(1), F.col("world")) * F.greatest(F.lit(0.01), F.col("efficiency"))
    tokens = F.coalesce(F.col("train_tokens_m"), F.lit(0.0)) * 1e6
    minutes = F.when(
        usable & (tps > 0) & (tokens > 0), F.round(tokens * penalty / fleet / 60.0, 1)
    )
    df = df.withColumn("est_time_min", minutes).withColumn(
        "est_cost_usd", cost_usd(F.col("est_time_min"), F.col("world"), F.col("hourly_cost"))
    )
    return df.select(
        "request_id",
        F.concat(
            F.when(F.col("variant") == 1, "qlora_").otherwise(""),
            "family",
            F.when(F.col("_auto"), "+ackpt").otherwise(""),
        ).alias("name"),
        F.col("family").alias("strategy_family"),
        F.col("world").cast("bigint").alias("workers"),
        F.when(usable, _policy_status(df)).otherwise("infeasible").alias("status"),
        "total_gb",
        offload_gb.alias("offload_gb"),
        F.when(fits, F.col("efficiency")).alias("efficiency"),
        "est_time_min",
        "est_cost_usd",
        (usable & (F.col("total_gb") > F.col("vram") * AUTO_FRACTION)).alias("profiling_required"),
        F.round(deficit, 2).alias("vram_deficit_gb"),
        F.when(usable, F.round(F.col("vram") - F.col("total_gb"), 2)).otherwise(0.0).alias("headroom_gb"),
        quantized.alias("quantized"),
        "position",
        "mode",
        "allow_quantization",
        "allow_cpu_offload",
    )


def evaluate_generic(resolved: DataFrame) -> DataFrame:
    df = generic_memory(training_candidates(resolved, "generic"))
    df = effective_link(df).withColumn("compute_s", F.lit(0.0))
    df = link_efficiency(df, F.lit(GENERIC_LAYERS))
    cap = F.col("vram") * HARD_FRACTION
    df = df.withColumn("_fits", F.col("total_gb") <= cap).withColumn(
        "_usable", F.col("_fits") & F.col("link_ok")
    )
    fits, usable = F.col("_fits"), F.col("_usable")
    minutes = F.when(
        usable & (F.col("est_gpu_hours") > 0),
        F.round(
            F.col("est_gpu_hours") * 60.0 / (F.col("world") * F.greatest(F.lit(0.01), F.col("efficiency"))), 1
        ),
    )
    df = df.withColumn("est_time_min", minutes).withColumn(
        "est_cost_usd", cost_usd(F.col("est_time_min"), F.col("world"), F.col("hourly_cost"))
    )
    return df.select(
        "request_id",
        F.when((F.col("world") == 1) | ~usable, F.col("family"))
        .otherwise(F.concat("family", F.lit("_x"), "world"))
        .alias("name"),
        F.col("family").alias("strategy_family"),
        F.col("world").cast("bigint").alias("workers"),
        F.when(usable, _policy_status(df)).otherwise("infeasible").alias("status"),
        "total_gb",
        F.lit(0.0).alias("offload_gb"),
        F.when(fits, F.col("efficiency")).alias("efficiency"),
        "est_time_min",
        "est_cost_usd",
        (usable & (F.col("total_gb") > F.col("vram") * AUTO_FRACTION)).alias("profiling_required"),
        F.round(F.greatest(F.lit(0.0), F.col("total_gb") - cap), 2).alias("vram_deficit_gb"),
        F.when(usable, F.round(F.col("vram") - F.col("total_gb"), 2)).otherwise(0.0).alias("headroom_gb"),
        F.lit(False).alias("quantized"),
        "position",
        "mode",
        "allow_quantization",
        "allow_cpu_offload",
    )


def _plain(df: DataFrame, **columns: Column) -> DataFrame:
    """Fill the output columns a simple candidate has no value for."""
    empty = {
        "total_gb": F.lit(None).cast("double"),
        "offload_gb": F.lit(0.0),
        "efficiency": F.lit(None).cast("double"),
        "est_time_min": F.lit(None).cast("double"),
        "est_cost_usd": F.lit(None).cast("double"),
        "profiling_required": F.lit(False),
        "vram_deficit_gb": F.lit(0.0),
        "headroom_gb": F.lit(0.0),
        "quantized": F.lit(False),
    }
    empty.update(columns)
    kept = ["request_id", "mode", "allow_quantization", "allow_cpu_offload"]
    place = F.struct(F.lit(0).alias("variant"), F.col("_p").alias("world"), F.lit(0).alias("family_no"))
    made = df.select(*kept, place.alias("position"), *[c.alias(n) for n, c in empty.items()])
    return made.select(*OUTPUT)


def evaluate_classical(resolved: DataFrame) -> DataFrame:
    """One process if three times the data fits in RAM; shards if learning is incremental."""
    rows = resolved.filter("kind = 'classical_ml'")
    fits = F.col("dataset_mb") * 3 / 1000.0 <= F.col("cpu_ram_gb") * HOST_RAM_FRACTION
    local = _plain(
        rows.withColumn("_p", F.lit(0)),
        name=F.lit("local_process"),
        strategy_family=F.lit("local_process"),
        workers=F.lit(1).cast("bigint"),
        status=F.when(fits, "feasible").otherwise("infeasible"),
    )
    blocks = F.floor(F.col("dataset_mb") / 500)
    shards = F.greatest(F.lit(2), F.least(F.lit(16), F.when(blocks == 0, 2).otherwise(blocks)))
    sharded = _plain(
        rows.filter("supports_partial_fit").withColumn("_p", F.lit(1)),
        name=F.lit("sharded_partial_fit"),
        strategy_family=F.lit("sharded_partial_fit"),
        workers=shards.cast("bigint"),
        status=F.lit("feasible"),
    )
    return local.unionByName(sharded)


def task_slots() -> Column:
    """Tasks that can run at once: GPUs, or one per four cores of each host."""
    cpu = F.col("hosts") * F.greatest(F.lit(1), F.floor(F.col("cpu_cores") / 4))
    wide = F.when(F.col("needs_gpu"), F.col("gpus")).otherwise(cpu)
    return F.greatest(F.lit(1), F.least(wide, F.col("task_count"))).cast("bigint")


def task_waves(requests: DataFrame) -> DataFrame:
    """Add ``slots``, ``waves`` (rounded up) and the minutes they take."""
    waves = F.ceil(F.col("task_count") / F.col("slots"))
    return (
        requests.withColumn("slots", task_slots())
        .withColumn("waves", waves)
        .withColumn("parallel_min", F.col("waves") * F.col("est_minutes_per_task"))
    )


def evaluate_tasks(resolved: DataFrame) -> DataFrame:
    rows = task_waves(
        resolved.filter((F.col("kind") == "independent_tasks") & F.col("problem").isNull())
    )
    too_big = (
        F.col("needs_gpu")
        & (F.col("gpus") > 0)
        & (F.col("vram_gb_per_task") > F.col("vram") * HARD_FRACTION)
    )
    rows = rows.withColumn("_big", F.coalesce(too_big, F.lit(False)))
    late = F.coalesce(
        (F.col("deadline_minutes") > 0) & (F.col("parallel_min") > F.col("deadline_minutes")), F.lit(False)
    )
    leased = _plain(
        rows.withColumn("_p", F.lit(0)),
        name=F.lit("lease_tasks"),
        strategy_family=F.lit("lease_tasks"),
        workers=F.when(F.col("_big"), 0).otherwise(F.col("slots")).cast("bigint"),
        status=F.when(F.col("_big"), "infeasible").when(late, "rejected_policy").otherwise("feasible"),
        total_gb=F.when(F.col("_big"), F.col("vram_gb_per_task")),
        est_time_min=F.when(~F.col("_big"), F.round("parallel_min", 1)),
        vram_deficit_gb=F.when(
            F.col("_big"), F.round(F.col("vram_gb_per_task") - F.col("vram"), 2)
        ).otherwise(0.0),
    )
    alone = _plain(
        rows.filter("NOT _big").withColumn("_p", F.lit(1)),
        name=F.lit("local_sequential"),
        strategy_family=F.lit("local_process"),
        workers=F.lit(1).cast("bigint"),
        status=F.when(F.col("slots") == 1, "feasible").otherwise("rejected_dominated"),
        est_time_min=F.round(F.col("task_count") * F.col("est_minutes_per_task"), 1),
    )
    return leased.unionByName(alone)


def candidates(requests: DataFrame) -> DataFrame:
    """Every candidate of every request with its verdict."""
    resolved = resolve(requests)
    return (
        evaluate_transformer(resolved)
        .unionByName(evaluate_generic(resolved))
        .unionByName(evaluate_classical(resolved))
        .unionByName(evaluate_tasks(resolved))
    )


# -- choice -------------------------------------------------------------------


def objective_key(cands: DataFrame) -> Column:
    """Sort key of a feasible candidate under its request's objective; unknown cost or
    time comes last."""
    inf = F.lit(float("inf"))
    cost = F.coalesce("est_cost_usd", inf)
    minutes = F.coalesce("est_time_min", inf)
    workers = F.col("workers").cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    return (
        F.when(F.col("mode") == "fastest", F.array(minutes, cost, workers, zero))
        .when(
            F.col("mode") == "reliable",
            F.array(
                workers,
                flag(F.col("strategy_family") == "zero3_cpu_offload"),
                flag(F.col("quantized")),
                -F.col("headroom_gb"),
            ),
        )
        .otherwise(F.array(cost, minutes, workers, zero))
    )


def rank_candidates(cands: DataFrame) -> DataFrame:
    """Feasible candidates in the order of the request's objective: ``rank`` from 1, and
    the next one's name as ``runner_up``.

    A request has at most some dozens of candidates, so the window stays small.
    """
    order = Window.partitionBy("request_id").orderBy("_k", "position")
    return (
        cands.filter("status = 'feasible'")
        .withColumn("_k", objective_key(cands))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("runner_up", F.lead("name").over(order))
        .drop("_k")
    )


def select_plans(requests: DataFrame) -> DataFrame:
    """One row per request: the chosen candidate and the runner-up, or the reason why
    there is none and what would come closest.

    One aggregation: the menu of a request is small by construction, so its
    feasible entries are sorted inside the row.
    """
    cands = candidates(requests)
    entry = F.struct(
        objective_key(cands).alias("k"), "position", "name", "workers", "total_gb", "est_time_min", "est_cost_usd"
    )
    judged = cands.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "feasible", entry))).alias("_menu"),
        F.min(
            F.when(F.col("vram_deficit_gb") > 0, F.struct("vram_deficit_gb", "position", "name"))
        ).alias("_near"),
        F.count_if(F.col("status") == "rejected_policy").alias("_policy"),
    )
    near = F.col("_near")
    hints = F.array_compact(
        F.array(
            F.when(
                near.isNotNull(),
                F.concat(
                    F.lit("closest "), near["name"], F.lit(" misses GPU memory by "),
                    F.format_string("%.1f", near["vram_deficit_gb"]), F.lit(" GB"),
                ),
            ),
            F.when(near.isNotNull() & ~F.col("allow_quantization"), F.lit("allow quantization")),
            F.when(near.isNotNull() & ~F.col("allow_cpu_offload"), F.lit("allow CPU offload")),
            F.when(
                F.col("_policy") > 0,
                F.concat("_policy", F.lit(" broke only the deadline or budget")),
            ),
        )
    )
    problem = resolve(requests).select("request_id", "problem", "allow_quantization", "allow_cpu_offload")
    out = problem.join(judged, "request_id", "left").withColumn("_best", F.get("_menu", 0))
    none_close = F.when(F.size(hints) == 0, F.array(F.lit("no candidate came close"))).otherwise(hints)
    return out.select(
        "request_id",
        F.col("_best.name").alias("selected"),
        "_best.workers",
        "_best.total_gb",
        "_best.est_time_min",
        "_best.est_cost_usd",
        F.get("_menu", 1)["name"].alias("runner_up"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(
            F.col("_best").isNull(),
            F.coalesce("problem", F.array_join(none_close, "; ")),
        ).alias("hint"),
    )


def order_candidates(cands: DataFrame) -> DataFrame:
    """Candidates by verdict, then workers, then name."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return cands.orderBy("request_id", place, "workers", "name")


def request_digest(requests: DataFrame, version: str) -> DataFrame:
    """Add ``digest``: equal requests sized by the same version get the same one."""
    stated = [F.col(c) for c in requests.columns if c != "request_id"]
    return requests.withColumn("digest", digest(*stated, F.lit(version).alias("version")))


def prefer_measured(cands: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Measured memory and time in place of the static ones where a profile exists.

    ``profiles``: ``keys``, ``peak_vram_gb``, ``est_time_min_measured``; a figure the
    profile lacks stays static. ``basis`` says which it is.
    """
    measured = profiles.select(*keys, "peak_vram_gb", "est_time_min_measured", F.lit(True).alias("_m"))
    return (
        cands.join(measured, keys, "left")
        .withColumn("total_gb", F.coalesce("peak_vram_gb", "total_gb"))
        .withColumn("est_time_min", F.coalesce("est_time_min_measured", "est_time_min"))
        .withColumn("basis", F.when(F.col("_m"), "profiled").otherwise("static"))
        .drop("_m", "peak_vram_gb", "est_time_min_measured")
    )

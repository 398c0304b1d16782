"""Validation, naming and expansion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import bindings as B
from millrace.functions import keys as K
from millrace.functions import readings as R
from millrace.operators import expansion as X
from millrace.operators import rules
from millrace.queries import query


@query(
    "artifact_keys",
    r"""WITH k AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'artifact://' || regexp_replace(url, '^https?://', '') END AS uri,
      CASE page_id % 4 WHEN 0 THEN 'delta.json' WHEN 1 THEN '../x.json' WHEN 2 THEN '.hidden' ELSE 'a b' END AS f FROM pages)
    SELECT page_id, CASE WHEN starts_with(uri, 'artifact://') THEN uri[12:] END AS key,
      CASE WHEN starts_with(uri, 'artifact://') THEN NOT starts_with(uri[12:], '/')
        AND NOT list_contains(string_split(uri[12:], '/'), '..') END AS safe,
      CASE WHEN regexp_full_match(f, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN
        regexp_replace('jobs/j/t' || page_id || '/metrics.json', '/[^/]*$', '') || '/' || f END AS delta
    FROM k""",
)
def artifact_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    uri = F.when(p % 3 == 0, F.col("url")).otherwise(
        K.key_to_uri(F.regexp_replace("url", "^https?://", ""))
    )
    file = (
        F.when(p % 4 == 0, "delta.json")
        .when(p % 4 == 1, "../x.json")
        .when(p % 4 == 2, ".hidden")
        .otherwise("a b")
    )
    key = K.uri_to_key(uri)
    return B.table(spark, sf, "pages").select(
        "page_id",
        key.alias("key"),
        K.is_safe_key(key).alias("safe"),
        K.delta_key(K.commit_key(F.lit("j"), F.concat(F.lit("t"), p)), file).alias("delta"),
    )


@query(
    "validate_jobs",
    """WITH j AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name
        ELSE lower(replace(c_name, '#', '-')) END AS name FROM customer)
    SELECT k AS job, array_to_string(list_filter([
      CASE WHEN NOT regexp_full_match(name, '[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?') THEN 'name is not a DNS-1123 label' END,
      CASE WHEN k % 5 = 0 THEN 'image tag is not pinned' END,
      CASE WHEN k % 7 = 0 THEN 'minimum workers below one' END,
      CASE WHEN k % 6 = 0 THEN 'maximum workers below one' END,
      CASE WHEN k % 6 < k % 7 THEN 'maximum workers below minimum workers' END,
      CASE WHEN k % 8 = 0 THEN 'output prefix has another scheme' END,
      CASE WHEN k % 9 = 0 THEN 'attempts below one' END], lambda x: x IS NOT NULL), '; ') AS problems FROM j""",
)
def validate_jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    jobs = B.table(spark, sf, "customer").select(
        k.alias("job"),
        F.when(k % 4 == 0, F.col("c_name"))
        .otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
        .alias("name"),
        F.when(k % 10 == 0, "latest").when(k % 5 == 0, "").otherwise("1.2").alias("image_tag"),
        (k % 7).alias("minimum_workers"),
        (k % 6).alias("maximum_workers"),
        F.when(k % 8 == 0, "s3://x/").otherwise("artifact://jobs/x/").alias("output_prefix"),
        (k % 9).alias("max_task_attempts"),
    )
    out = rules.validate_jobs(jobs)
    return out.select("job", F.array_join("problems", "; ").alias("problems"))


@query(
    "validate_commands",
    """SELECT c_custkey AS job, array_to_string(list_filter([
      CASE WHEN c_custkey % 3 <> 0 THEN 'command is not a non-empty list of texts' END,
      CASE WHEN c_custkey % 4 = 0 THEN 'input ''data'' is not an artifact address' END,
      CASE WHEN c_custkey % 5 = 0 THEN 'task_params is not a list of objects' END,
      CASE WHEN c_custkey % 7 = 1 THEN 'unpack_inputs is not a list of names' END,
      CASE WHEN c_custkey % 7 = 2 THEN 'unpacked more than once: data' END,
      CASE WHEN c_custkey % 7 IN (2, 3) THEN 'unpacked but not declared: other' END],
      lambda x: x IS NOT NULL), '; ') AS problems FROM customer""",
)
def validate_commands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    members = F.array_compact(
        F.array(
            F.when(k % 3 == 0, '"command":["run","{x}"]')
            .when(k % 3 == 1, '"command":[]')
            .otherwise('"command":["run",1]'),
            F.when(k % 4 == 0, '"inputs":{"data":"s3://x"}').otherwise('"inputs":{"data":"artifact://x"}'),
            F.when(k % 5 == 0, '"task_params":[1]').when(k % 5 == 1, '"task_params":[{"x":1}]'),
            F.when(k % 7 == 1, '"unpack_inputs":"data"')
            .when(k % 7 == 2, '"unpack_inputs":["data","data","other"]')
            .when(k % 7 == 3, '"unpack_inputs":["data","other"]')
            .when(k % 7 == 4, '"unpack_inputs":["data"]'),
        )
    )
    df = B.table(spark, sf, "customer").select(
        k.alias("job"),
        F.parse_json(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).alias("parameters"),
    )
    return rules.validate_commands(df).select("job", F.array_join("problems", "; ").alias("problems"))


@query(
    "clean_readings",
    """WITH r AS (SELECT event_id, event_id % 7 AS k, value FROM events)
    SELECT event_id,
      CASE WHEN k IN (0, 1, 6) THEN value WHEN k = 2 THEN 250 END AS reading,
      CASE WHEN k IN (0, 1, 6) AND value BETWEEN 0 AND 100 THEN value END AS percent,
      CASE WHEN k IN (0, 1, 6) AND value > 0 THEN least(value, 3600) WHEN k = 2 THEN 250
           WHEN k = 5 THEN 60 END AS lease_s,
      k = 4 AS metrics_ok FROM r""",
)
def clean_readings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 7
    text = (
        F.when(k == 2, "250")
        .when(k == 3, "true")
        .when(k == 4, '{"loss":1}')
        .when(k == 5, "null")
        .otherwise(F.col("value").cast("string"))
    )
    v = F.parse_json(text)
    return B.table(spark, sf, "events").select(
        "event_id",
        R.reading(v).alias("reading"),
        R.percent(v).alias("percent"),
        R.clean_lease_seconds(v, 60.0).alias("lease_s"),
        R.valid_metrics(v).alias("metrics_ok"),
    )


@query(
    "valid_outputs",
    """SELECT o_orderkey AS k, coalesce(o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0, false) AS output_valid FROM orders""",
)
def valid_outputs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = B.table(spark, sf, "orders")
    key = K.commit_key(F.lit("j"), k.cast("string"))
    attempts = o.select(k.alias("k"), key.alias("commit_key"), F.sha2(k.cast("string"), 256).alias("output_sha256"))
    artifacts = o.filter(k % 5 != 0).select(
        key.alias("key"),
        F.when(k % 7 == 0, "damaged").otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"),
    )
    return rules.valid_outputs(attempts, artifacts).select("k", "output_valid")


@query(
    "expand_grid",
    """WITH j AS (SELECT p_partkey AS k, 1 + p_partkey % 3 AS na, 1 + p_size % 4 AS nb FROM part),
    t AS (SELECT *, unnest(generate_series(0, na * nb - 1)) AS i FROM j)
    SELECT 'job-' || k AS job_id, 'trial-' || lpad(i::VARCHAR, 3, '0') AS task_id,
      'c' || (i // nb) AS c, 'd' || (i % nb) AS depth FROM t""",
)
def expand_grid(spark: SparkSession, sf: str) -> DataFrame:
    values = lambda p, n: F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.concat(F.lit(p), i)
    )
    jobs = B.table(spark, sf, "part").select(
        F.concat(F.lit("job-"), F.col("p_partkey")).alias("job_id"),
        F.create_map(
            F.lit("depth"),
            values("d", F.lit(1) + F.col("p_size") % 4),
            F.lit("C"),
            values("c", F.lit(1) + F.col("p_partkey") % 3),
        ).alias("grid"),
    )
    out = X.expand_grid(jobs)
    return out.select(
        "job_id", "task_id", F.col("params")["C"].alias("c"), F.col("params")["depth"].alias("depth")
    )


@query(
    "expand_tasks",
    """WITH j AS (SELECT c_custkey AS k, c_custkey % 4 AS kind, c_custkey % 13 AS n FROM customer),
    p AS (SELECT *, CASE WHEN kind = 2 AND n < 1 THEN 'number of shards below 1'
      WHEN kind = 1 AND n % 5 = 4 THEN 'shard is not an artifact address'
      WHEN kind = 3 AND n % 2 = 1 AND n % 3 = 0 THEN 'fallback without a pool'
      WHEN kind = 1 AND n = 0 THEN 'nothing to expand' END AS problem,
      CASE kind WHEN 0 THEN 6 WHEN 3 THEN greatest(n, 1) ELSE n END AS cnt FROM j),
    t AS (SELECT *, CASE WHEN problem IS NULL THEN unnest(generate_series(0, cnt - 1)) END AS i FROM p WHERE problem IS NULL
      UNION ALL SELECT *, NULL FROM p WHERE problem IS NOT NULL),
    r AS (SELECT *, lpad(i::VARCHAR, 3, '0') AS pi, 'job-' || k AS job_id FROM t)
    SELECT job_id, CASE kind WHEN 0 THEN 'trial-' || pi WHEN 1 THEN 'it07-shard-' || pi
        WHEN 2 THEN 'shard-' || pi ELSE 'task-' || pi END AS task_id,
      CASE WHEN n % 3 <> 0 THEN 'pool-' || (n % 3) END AS pool, problem,
      CASE WHEN kind = 0 THEN 'b' || (i % 3) END AS b,
      CASE WHEN kind = 1 AND problem IS NULL THEN 'artifact://s' || i END AS input FROM r""",
)
def expand_tasks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    n, kind = k % 13, k % 4
    jobs = B.table(spark, sf, "customer").select(
        F.concat(F.lit("job-"), k).alias("job_id"),
        F.get(
            F.array(
                *[
                    F.lit(v)
                    for v in ("hyperparameter_search", "sharded_kmeans", "federated_averaging", "command")
                ]
            ),
            kind.cast("int"),
        ).alias("kind"),
        F.create_map(
            F.lit("b"), F.array(F.lit("b0"), F.lit("b1"), F.lit("b2")), F.lit("a"), F.array(F.lit("x"), F.lit("y"))
        ).alias("grid"),
        F.when(
            n > 0,
            F.transform(
                F.sequence(F.lit(0), (n - 1).cast("int")),
                lambda i: F.concat(
                    F.when(n % 5 == 4, "file://s").otherwise("artifact://s"), i
                ),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("shards"),
        n.alias("num_shards"),
        F.lit(7).alias("iteration"),
        n.alias("task_count"),
        F.lit("sandboxed").alias("tier"),
        (n % 2 == 1).alias("allow_fallback"),
        F.when(n % 3 == 0, "any").otherwise(F.concat(F.lit("pool-"), n % 3)).alias("pool"),
        F.lit(0).alias("gpus"),
        F.lit(3).alias("max_attempts"),
        F.lit(60.0).alias("lease_seconds"),
    )
    out = X.expand_tasks(jobs)
    return out.select("job_id", "task_id", "pool", "problem", F.col("params")["b"].alias("b"), "input")


@query(
    "text_templates",
    """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'run {lang} of {source}' WHEN 1 THEN 'raw {{x}} {lang}'
        ELSE 'bad {missing}' END AS tpl, lang, source FROM documents)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'run ' || lang || ' of ' || source
      WHEN 1 THEN 'raw {x} ' || lang END AS filled, doc_id % 3 = 0 AS restart FROM t""",
)
def text_templates(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id") % 3
    template = (
        F.when(d == 0, "run {lang} of {source}").when(d == 1, "raw {{x}} {lang}").otherwise("bad {missing}")
    )
    params = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    attempt = F.when(d == 0, "task-001-r2").otherwise("task-001")
    return B.table(spark, sf, "documents").select(
        "doc_id", K.fill(template, params).alias("filled"), K.is_restart(attempt).alias("restart")
    )


@query(
    "external_job_states",
    """SELECT event_id, CASE
      WHEN event_id % 5 = 0 THEN 'SUCCEEDED' WHEN event_id % 5 = 1 OR event_id % 4 = 0 THEN 'FAILED'
      WHEN event_id % 5 = 2 THEN 'RUNNING' WHEN event_id % 5 = 3 THEN 'CANCELLED'
      WHEN event_id % 4 = 1 THEN 'RUNNING' WHEN event_id % 4 = 2 THEN 'SUCCEEDED' ELSE 'SUBMITTED' END AS state
    FROM events""",
)
def external_job_states(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda values, n: F.get(
        F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n).cast("int")
    )
    return B.table(spark, sf, "events").select(
        "event_id",
        R.external_job_state(
            pick(["Failed", "Running", "Complete", "Waiting"], 4),
            pick(["SUCCEEDED", "FAILED", "RUNNING", "STOPPED", ""], 5),
        ).alias("state"),
    )


@query(
    "labels_and_digests",
    """SELECT page_id, page_id % 3 <> 0 AS digest_ok, CASE WHEN page_id % 2 = 0 THEN 'amd64' END AS arch,
    CASE WHEN page_id % 4 <> 1 THEN page_id % 4 = 0 ELSE true END AS has_data FROM pages""",
)
def labels_and_digests(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.eligibility import has_all

    p = F.col("page_id")
    text = F.when(p % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("sha256:"), F.sha2("url", 256)))
    labels = F.create_map(
        F.when(p % 2 == 0, "kubernetes.io/arch").otherwise("private/arch"), F.lit("amd64")
    )
    required = F.when(p % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    advertised = F.when(p % 4 == 0, F.array(F.lit("b"), F.lit("a"))).when(p % 4 == 2, F.array(F.lit("a")))
    return B.table(spark, sf, "pages").select(
        "page_id",
        K.is_digest(text).alias("digest_ok"),
        K.keep_labels(labels, ["kubernetes.io/"])["kubernetes.io/arch"].alias("arch"),
        has_all(required, advertised).alias("has_data"),
    )

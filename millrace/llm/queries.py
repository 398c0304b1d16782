"""Registered queries of the operators: thin digests over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bpe_counts, decontaminate, licenses, line_dedup, manifest, pages, pieces, quality, simhash, substrings, toxicity,
    vector_dups, whitening,
)
from millrace.llm.training import held_out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    "op1_line_dedup",
    r"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.owner AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""


@query(
    "op4_decontamination",
    rf"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
          array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, s, n FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM p)
      JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS place FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.select("doc_id", digits, "component_id")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = quality.score(docs.select("doc_id", "text"), quality.learn(docs, table(spark, sf, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = bpe_counts.token_counts(docs, _tokenizer("word_bpe_49k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return rows.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op6_license_scan")
def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, table(spark, sf, "labels")))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = pieces.round_trip(docs, _tokenizer("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op5_embedding_near_dedup")
def op5_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = vector_dups.link_vectors(table(spark, sf, "embeddings"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return rows.select("vec_id", "n_links", "component_id", kept)


@query(
    "op11_merkle_manifest",
    r"""WITH RECURSIVE
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
        FROM (SELECT unnest(range(256))::BIGINT AS i)),
d AS (SELECT doc_id, source, lang, n_chars, text,
        CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0
             THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
      FROM documents, crc),
e AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(changed) || ':' || changed, '-') AS alt FROM d),
leaves AS (SELECT doc_id, lang, sha256(head || own) AS leaf, sha256(head || alt) AS other,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || own)) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM e),
low AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low
            WHERE n > 1 GROUP BY lang, lvl, i // 8, n),
subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
up AS (SELECT 0 AS lvl, i, n, h FROM subs
  UNION ALL SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM up
            WHERE n > 1 GROUP BY lvl, i // 8, n),
lows AS (SELECT lang, lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM low WHERE n > 1),
ups AS (SELECT lvl, i, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM up WHERE n > 1),
steps AS (SELECT f.lang, f.i, lvl, l, r FROM leaves f JOIN lows s ON f.lang IS NOT DISTINCT FROM s.lang AND s.i = f.i >> (3 * lvl)
  UNION ALL SELECT f.lang, f.i, 100 + lvl, l, r FROM leaves f JOIN subs b ON f.lang IS NOT DISTINCT FROM b.lang
            JOIN ups s ON s.i = b.i >> (3 * lvl)),
paths AS (SELECT lang, i, list({'l': l, 'r': r} ORDER BY lvl) AS path FROM steps GROUP BY lang, i),
root AS (SELECT h AS root FROM up WHERE n = 1),
done AS (SELECT f.doc_id, f.leaf, b.h AS subroot, root,
           sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
           list_reduce(list_prepend({'l': f.other, 'r': ''}, coalesce(path, [])),
             lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root
         FROM leaves f JOIN subs b ON f.lang IS NOT DISTINCT FROM b.lang
         LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i, root)
SELECT *, folded_root = root AS verified FROM done""",
)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = manifest.proofs(manifest.manifest(table(spark, sf, "documents"), manifest.lower_cased()))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = rows.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = substrings.drop_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

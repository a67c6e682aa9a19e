"""Batch request files and the jobs that run them."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.operators import batches as B
from placegrid.plans.registry import query

PER_SHARD = 64

# image references with their fetch outcome, then requests with what was kept
_IMAGES = """
refs AS (SELECT doc_id, key, unnest(images) AS url, generate_subscripts(images, 1) - 1 AS pos, optional_images FROM v_skeleton),
got AS (SELECT r.doc_id, r.key, r.url, r.pos, m.content_text, list_contains(optional_images, r.url) AS optional,
  lower(coalesce(m.error, 'no response')) AS failure FROM refs r LEFT JOIN v_media m ON r.url = m.url),
imgs AS (SELECT key, list(base64(encode(content_text)) ORDER BY pos) FILTER (content_text IS NOT NULL) AS data,
  max(CASE WHEN content_text IS NULL AND NOT optional AND NOT contains(failure, 'http 404') THEN 'fetch failed ' || url END) AS error
  FROM got GROUP BY ALL),
requests AS (SELECT s.doc_id, s.key, s.prompt, coalesce(i.data, []) AS data, CAST(len(coalesce(i.data, [])) AS BIGINT) AS n_images, i.error
  FROM v_skeleton s LEFT JOIN imgs i ON s.key = i.key)"""


def _requests(t):
    skeleton = t.skeleton.withColumn("generation_config", F.lit('{"temperature":0.5,"mode":"x"}'))
    media = t.media.select("url", F.encode("content_text", "UTF-8").alias("content"), "error")
    return B.attach_images(skeleton, media)


@query("D15", f"""WITH {_IMAGES}
SELECT key, n_images, error, array_to_string(data, ' ') AS data, md5(prompt) AS digest FROM requests""")
def attach_images(t):
    return _requests(t).select(
        "key", "n_images", "error", F.array_join("image_data", " ").alias("data"), F.md5("prompt").alias("digest")
    )


@query("B12 D15", f"""WITH {_IMAGES}
SELECT key, printf('shard_%03d', doc_id // {PER_SHARD}) AS shard, '{{"key":"' || key || '","request":{{"contents":[{{"parts":[{{"text":'
  || to_json(prompt) || '}}' || array_to_string(list_transform(data, lambda d: ',{{"inlineData":{{"mimeType":"image/jpeg","data":"' || d || '"}}}}'), '')
  || ']}}],"generationConfig":{{"mode":"x","temperature":0.5}}}}}}' AS value FROM requests WHERE error IS NULL""")
def request_lines(t):
    sharded = B.assign_shard(_requests(t), F.col("doc_id"), PER_SHARD)
    return B.request_lines(sharded, ["shard"]).select("key", "shard", "value")


@query("E18 D15", f"""WITH {_IMAGES}
SELECT printf('shard_%03d', doc_id // {PER_SHARD}) AS shard, count(*) AS count, CAST(sum(n_images) AS BIGINT) AS images,
  string_agg(key, ' ' ORDER BY doc_id) AS keys FROM requests GROUP BY 1""")
def shard_stubs(t):
    stubs = B.shard_stub(B.assign_shard(_requests(t), F.col("doc_id"), PER_SHARD), "doc_id")
    return stubs.withColumn("keys", F.array_join("keys", " "))


@query("F9", """
WITH shards AS (SELECT doc_id // 16 AS pos, CAST(sum(n_chars) AS BIGINT) * 1000 AS size_bytes FROM documents GROUP BY 1),
r AS (SELECT *, CAST(sum(size_bytes) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM shards)
SELECT * FROM r WHERE total_bytes + 100000000 <= 1000000000""")
def admit_by_budget(t):
    shards = t.base("documents").groupBy(F.floor(F.col("doc_id") / 16).alias("pos")).agg(
        (F.sum("n_chars") * 1000).alias("size_bytes")
    )
    return B.admit_by_budget(shards, "pos", active=100_000_000, budget=1_000_000_000)


_JOBS = """
jobs AS (SELECT *, split_part(display_name, '/', 1) AS client, split_part(display_name, '/', 2) AS dataset,
  split_part(display_name, '/', 3) AS shard FROM v_jobs WHERE len(string_split(display_name, '/')) = 3)"""
_NEWEST = f"""{_JOBS},
newest AS (SELECT *, CASE WHEN state = 'JOB_STATE_SUCCEEDED' AND request_count > 0 AND pending_request_count >= request_count
    THEN 'JOB_STATE_CANCELLED' ELSE state END AS eff FROM jobs
  QUALIFY row_number() OVER (PARTITION BY display_name ORDER BY create_time DESC, name DESC) = 1),
files AS (SELECT display_name AS f, max(name) AS src_file FROM v_job_files GROUP BY ALL),
swept AS (SELECT n.client, n.dataset, n.shard, n.name, n.display_name, n.eff AS state, model, f.src_file, create_time, update_time, request_count, pending_request_count,
    '2026-01-02T03:04:05Z' AS checked_at,
    CASE WHEN eff = 'JOB_STATE_SUCCEEDED' AND (r.client IS NOT NULL OR dest_file <> '')
      THEN 'https://store/llm-batch/' || n.client || '/' || n.dataset || '/results/' || n.shard || '.jsonl' END AS results_url,
    CASE WHEN eff = 'JOB_STATE_SUCCEEDED' AND (r.client IS NOT NULL OR dest_file <> '') THEN '2026-01-02T03:04:05Z' END AS collected_at,
    CASE WHEN eff IN ('JOB_STATE_FAILED', 'JOB_STATE_EXPIRED', 'JOB_STATE_CANCELLED') THEN coalesce(left(n.error, 500), eff) END AS error,
    eff = 'JOB_STATE_SUCCEEDED' AND r.client IS NULL AND dest_file <> '' AS newly_collected,
    eff = 'JOB_STATE_SUCCEEDED' AND r.client IS NULL AND dest_file = '' AS skipped,
    eff IN ('JOB_STATE_FAILED', 'JOB_STATE_EXPIRED', 'JOB_STATE_CANCELLED') AS failed,
    eff NOT IN ('JOB_STATE_SUCCEEDED', 'JOB_STATE_FAILED', 'JOB_STATE_EXPIRED', 'JOB_STATE_CANCELLED') AS unfinished,
    eff <> 'JOB_STATE_RUNNING' AND f.src_file IS NULL AS input_deleted
  FROM newest n LEFT JOIN files f ON f.f = n.client || '_' || n.dataset || '_' || n.shard || '.jsonl'
  LEFT JOIN v_job_results r ON r.client = n.client AND r.dataset = n.dataset AND r.shard = n.shard),
status AS (SELECT * EXCLUDE (skipped) FROM swept WHERE NOT skipped)"""


def _sweep(t):
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    return B.sweep(t.jobs, t.job_files, t.job_results, "https://store", now)


@query("C15", f"WITH {_JOBS} SELECT name, client, dataset, shard FROM jobs WHERE client = 'c3'")
def batch_jobs(t):
    return B.batch_jobs(t.jobs, client="c3").select("name", "client", "dataset", "shard")


@query("F7", f"WITH {_NEWEST} SELECT name, display_name, create_time FROM newest")
def newest_jobs(t):
    return B.newest_job(B.batch_jobs(t.jobs)).select("name", "display_name", "create_time")


@query("I32", """
SELECT name, CASE WHEN state = 'JOB_STATE_SUCCEEDED' AND request_count > 0 AND pending_request_count >= request_count
  THEN 'JOB_STATE_CANCELLED' ELSE state END AS state FROM v_jobs""")
def effective_states(t):
    return t.jobs.select("name", B.effective_state("state", "request_count", "pending_request_count").alias("state"))


@query("D13", f"WITH {_NEWEST} SELECT display_name, src_file FROM swept")
def attach_input_file(t):
    jobs = B.newest_job(B.batch_jobs(t.jobs))
    return B.attach_input_file(jobs, t.job_files).select("display_name", "src_file")


@query("D12", f"WITH {_NEWEST} SELECT display_name, name FROM status WHERE newly_collected")
def uncollected(t):
    jobs = B.newest_job(B.batch_jobs(t.jobs)).withColumn(
        "state", B.effective_state("state", "request_count", "pending_request_count")
    )
    return B.uncollected(jobs, t.job_results).select("display_name", "name")


@query("B13 I32 D13 F7 C15", f"WITH {_NEWEST} SELECT * FROM status")
def job_status(t):
    return B.status_rows(_sweep(t))


@query("E12", f"""WITH {_NEWEST}
SELECT count(*) AS jobs_seen, count(*) FILTER (newly_collected) AS newly_collected, count(*) FILTER (failed) AS failed,
  count(*) FILTER (unfinished) AS unfinished FROM swept""")
def sweep_summary(t):
    return B.sweep_summary(_sweep(t))

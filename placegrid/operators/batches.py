"""Batch request files with inlined images, and the jobs that run them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.outcomes import BAD_STATES, SUCCEEDED, effective_state, job_error
from placegrid.functions.values import blank
from placegrid.operators.dedupe import first_seen
from placegrid.operators.ordered import even_chunks, running_sum

# Upload budget in bytes, mime type, fetch failures that only drop an image.
FILES_BUDGET = 17_000_000_000
IMAGE_MIME = "image/jpeg"
DROPPABLE = ("truncated", "cannot identify", "decoder", "http 404")


def attach_images(skeleton: DataFrame, media: DataFrame, salts: int = 32, hot: int = 1000) -> DataFrame:
    """Requests with their images in order, `n_images`, and `error` where a required one failed.

    media: url, content (binary, null on failure), error. Only (key, position, url)
    goes through the image join; prompts are shuffled once. References are dealt over
    `salts` copies of an image that more than `hot` of them name, so a logo that every
    request shows does not meet all of them in one task.
    """
    refs = skeleton.select(
        "key", F.posexplode("images").alias("pos", "url"), "optional_images"
    ).select(
        "key", "pos", "url",
        F.coalesce(F.array_contains("optional_images", F.col("url")), F.lit(False)).alias("optional"),
    )
    failure = F.lower(F.coalesce("error", F.lit("no response")))
    dropped = F.col("optional")
    for hint in DROPPABLE:
        dropped = dropped | failure.contains(hint)
    got = F.col("content").isNotNull()
    busy = refs.groupBy("url").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select(
        "url", F.lit(salts).alias("_salts"))
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    copies = media.join(busy, "url", "left").withColumn("_salt", spread).drop("_salts")
    dealt = refs.join(busy, "url", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("key", "pos"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    images = (
        dealt.join(copies, ["url", "_salt"], "left")
        .groupBy("key")
        .agg(
            F.sort_array(
                F.collect_list(F.when(got, F.struct("pos", F.base64("content").alias("data"))))
            ).alias("_images"),
            F.max(F.when(~got & ~dropped, F.concat(F.lit("fetch failed "), F.col("url")))).alias("error"),
        )
    )
    parts = F.transform(F.coalesce("_images", F.array().cast("array<struct<pos:int,data:string>>")), lambda i: i["data"])
    return skeleton.join(images, "key", "left").select(
        *skeleton.columns, parts.alias("image_data"),
        F.size(parts).cast("bigint").alias("n_images"), "error",
    )


def request_lines(requests: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON request per line: the prompt part first, then the images."""
    nothing = F.lit(None).cast("struct<mimeType:string,data:string>")
    text = F.array(F.struct(F.col("prompt").alias("text"), nothing.alias("inlineData")))
    pictures = F.transform(
        "image_data",
        lambda d: F.struct(
            F.lit(None).cast("string").alias("text"),
            F.struct(F.lit(IMAGE_MIME).alias("mimeType"), d.alias("data")).alias("inlineData"),
        ),
    )
    config = F.try_parse_json(F.coalesce("generation_config", F.lit("{}")))
    body = F.struct(
        F.array(F.struct(F.concat(text, pictures).alias("parts"))).alias("contents"),
        config.alias("generationConfig"),
    )
    return requests.filter(F.col("error").isNull()).select(
        *keep, "key", "n_images",
        F.to_json(F.struct("key", body.alias("request"))).alias("value"),
    )


def assign_shard(requests: DataFrame, position: Column, per_shard: int) -> DataFrame:
    """Shards of at most `per_shard` requests, cut by a unique position."""
    return requests.withColumn("shard", F.format_string("shard_%03d", F.floor(position / per_shard)))


def shard_stub(requests: DataFrame, order: str) -> DataFrame:
    """count, image count and ordered keys per shard; a shard's size is bounded when it is cut."""
    keys = F.sort_array(F.collect_list(F.struct(order, "key")))
    return requests.groupBy("shard").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n_images").alias("images"), keys.alias("_k")
    ).withColumn("keys", F.transform("_k", lambda k: k["key"])).drop("_k")


def admit_by_budget(
    shards: DataFrame, position: str, active: int = 0, budget: int = FILES_BUDGET
) -> DataFrame:
    """Shard files in order while they fit beside what is already uploaded."""
    rows = running_sum(shards, [], even_chunks(shards, position), [position], F.col("size_bytes"), "total_bytes")
    return rows.filter(F.col("total_bytes") + active <= budget)


def batch_jobs(jobs: DataFrame, client: str | None = None, dataset: str | None = None) -> DataFrame:
    """Jobs whose display name has exactly the parts client/dataset/shard."""
    parts = F.split(blank("display_name"), "/")
    rows = jobs.withColumn("_p", parts).filter(F.size("_p") == 3).withColumns(
        {n: F.get("_p", F.lit(i)) for i, n in enumerate(("client", "dataset", "shard"))}
    ).drop("_p")
    for name, wanted in (("client", client), ("dataset", dataset)):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    return rows


def newest_job(jobs: DataFrame) -> DataFrame:
    """The latest job of each display name."""
    latest = [
        F.try_to_timestamp("create_time").desc_nulls_last(), F.col("create_time").desc_nulls_last(),
        F.col("name").desc(),
    ]
    return first_seen(jobs, ["display_name"], latest)


def attach_input_file(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The uploaded input of a job; null once it was deleted."""
    named = files.groupBy(F.col("display_name").alias("_file")).agg(F.max("name").alias("src_file"))
    wanted = F.concat_ws("_", "client", "dataset", "shard")
    return jobs.withColumn("_file", F.concat(wanted, F.lit(".jsonl"))).join(named, "_file", "left").drop("_file")


def uncollected(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Succeeded jobs that have no result file yet; inline jobs, which name none to fetch, publish their own."""
    won = jobs.filter((F.col("state") == SUCCEEDED) & (blank("dest_file") != ""))
    return won.join(results.select("client", "dataset", "shard"), ["client", "dataset", "shard"], "left_anti")


def sweep(
    jobs: DataFrame, files: DataFrame, results: DataFrame, container: str = "", now: Column | None = None
) -> DataFrame:
    """Status rows of the newest job per name: effective state, input file, error, flags.

    `skipped` marks succeeded inline jobs without results: they are seen, but get no status
    file (`status_rows`) and are not collected.
    """
    checked = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    newest = newest_job(batch_jobs(jobs)).withColumn(
        "state", effective_state("state", "request_count", "pending_request_count")
    )
    stored = results.select("client", "dataset", "shard", F.lit(True).alias("_had")).distinct()
    rows = attach_input_file(newest, files).join(stored, ["client", "dataset", "shard"], "left")
    won, bad = F.col("state") == SUCCEEDED, F.col("state").isin(*BAD_STATES)
    skipped = won & F.col("_had").isNull() & (blank("dest_file") == "")
    kept = won & ~skipped
    url = F.concat(F.lit(f"{container}/llm-batch/"), F.concat_ws("/", "client", "dataset"), F.lit("/results/"), "shard", F.lit(".jsonl"))
    return rows.select(
        "client", "dataset", "shard", "name", "display_name", "state", "model", "src_file", "create_time", "update_time",
        "request_count", "pending_request_count",
        checked.alias("checked_at"), F.when(kept, url).alias("results_url"), F.when(kept, checked).alias("collected_at"),
        job_error(F.col("state"), F.col("error")).alias("error"),
        (kept & F.col("_had").isNull()).alias("newly_collected"), skipped.alias("skipped"),
        bad.alias("failed"), (~won & ~bad).alias("unfinished"),
        ((won | bad) & F.col("src_file").isNull()).alias("input_deleted"),
    )


def status_rows(swept: DataFrame) -> DataFrame:
    """What is written as status: all but the skipped jobs."""
    return swept.filter(~F.col("skipped")).drop("skipped")


def sweep_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("jobs_seen"),
        F.count_if("newly_collected").alias("newly_collected"),
        F.count_if("failed").alias("failed"),
        F.count_if("unfinished").alias("unfinished"),
    )

"""Gallery walks, image classes and media plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions import media as M
from placegrid.functions.values import blank

# Repeats that end a gallery walk.
STALE_STEPS = 3


def walk_gallery(items: DataFrame, cap: int = M.GALLERY_CAP) -> DataFrame:
    """Emitted gallery items of each place, at most `cap`, ending after three repeats in a row.

    A walk takes at most twice `cap` items by position, whatever their step numbers; later
    ones are dropped first, which bounds the rows of a place. Items of one step follow
    each other in the order of their fields.
    """
    src = F.when(~M.is_video("cap"), F.col("img"))
    place = Window.partitionBy("place_id").orderBy("_at")
    walk = Window.partitionBy("place_id").orderBy("step", "img", "vid", "cap", "attr")
    so_far = place.rowsBetween(Window.unboundedPreceding, 0)
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    signature = F.concat_ws(
        "|", F.coalesce("cap", F.lit("∅")), F.coalesce("vid", F.lit("∅")), M.url_base(blank("_src"))
    )
    over = (F.col("_stale") >= STALE_STEPS) | (F.col("_emitted") >= cap)
    return (
        items.withColumn("_at", F.row_number().over(walk))
        .filter(F.col("_at") <= 2 * cap)
        .withColumn("_src", src)
        .withColumn("_sig", signature)
        .withColumns(
            {
                "_new": ~F.array_contains(F.collect_list("_sig").over(earlier), F.col("_sig")),
                "kind": M.photo_kind("_src", "cap", "attr"),
            }
        )
        .withColumn("_out", F.col("_new") & F.col("kind").isNotNull())
        .withColumns(
            {
                "_stale": F.col("_at")
                - F.coalesce(F.max(F.when(F.col("_new"), F.col("_at"))).over(so_far), F.lit(0)),
                "_emitted": F.count_if("_out").over(so_far),
            }
        )
        .withColumn("_over", F.coalesce(F.max(over).over(earlier), F.lit(False)))
        .filter(F.col("_out") & ~F.col("_over"))
        .select(
            "place_id", "step", F.col("_src").alias("url"),
            F.coalesce("cap", "attr").alias("date"), "kind",
        )
    )


def imagery_class(places: DataFrame, photos: DataFrame) -> DataFrame:
    """photos, street_view_only or none; unknown only where the capture failed with no photos."""
    found = photos.groupBy("place_id").agg(
        F.max(F.col("kind").isin("photo", "video")).alias("_real"), F.lit(True).alias("_any")
    )
    return places.join(found, "place_id", "left").select(
        "place_id",
        F.when(F.col("_real"), "photos")
        .when(F.col("_any"), "street_view_only")
        .when(F.col("capture_error"), "unknown")
        .otherwise("none").alias("imagery"),
    )


def place_photos(listings: DataFrame, run_id: str, cap: int = M.MIRROR_CAP) -> DataFrame:
    """Photo blobs of a place, numbered from 1 over its distinct URLs."""
    urls = M.cap_images(M.dedupe_image_urls(F.array_join(M.split_image_urls("image_urls"), ";")), cap)
    run = F.lit(run_id)
    return listings.select(
        "place_id", "content_type", F.posexplode(urls).alias("_pos", "url")
    ).select(
        "place_id", F.lit("photo").alias("kind"), (F.col("_pos") + 1).cast("bigint").alias("seq"), "url",
        M.photo_name(run, "place_id", F.col("_pos") + 1, M.ext_for_ctype("content_type")).alias("blob"),
    )


def menu_photos(horeca: DataFrame, run_id: str) -> DataFrame:
    """Menu-card blobs, numbered from 0 in capture order; cards without a URL keep their number."""
    return (
        horeca.select("place_id", F.posexplode("menu_photos").alias("_pos", "p"))
        .filter(blank(F.col("p.url")) != "")
        .select(
            "place_id", F.lit("menu").alias("kind"), F.col("_pos").cast("bigint").alias("seq"),
            M.menu_fullres(F.col("p.url")).alias("url"),
            M.menu_photo_name(F.lit(run_id), "place_id", "_pos").alias("blob"),
        )
    )


def plan_media(listings: DataFrame, horeca: DataFrame, run_id: str) -> DataFrame:
    return place_photos(listings, run_id).unionByName(menu_photos(horeca, run_id))


def new_media(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned blobs that are not stored yet."""
    return plan.join(manifest.select("blob"), "blob", "left_anti")


def media_totals(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Expected and saved per place; partial where they differ."""
    both = plan.select("place_id", F.lit(1).alias("e"), F.lit(0).alias("s")).unionByName(
        stored.select("place_id", F.lit(0).alias("e"), F.lit(1).alias("s"))
    )
    counts = both.groupBy("place_id").agg(F.sum("e").alias("expected"), F.sum("s").alias("saved"))
    return counts.withColumn("partial", F.col("saved") < F.col("expected"))


def shot_manifest(shots: DataFrame, run_id: str) -> DataFrame:
    """One JSON line per panel screenshot."""
    name = F.concat(M.safe_name("place_id"), F.lit("_"), F.col("kind"), F.lit(".png"))
    return shots.select(
        F.to_json(
            F.struct(F.lit(run_id).alias("run_id"), "place_id", "kind", "attempts", name.alias("file"))
        ).alias("value")
    )

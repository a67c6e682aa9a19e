"""Image URLs, media names and photo kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegrid.functions.panel import keep_first
from placegrid.functions.values import blank, col, filled, strip

# Caps on images per place, size suffix, smallest large image, content types.
DOWNLOAD_CAP, MIRROR_CAP, GALLERY_CAP = 50, 15, 12
FULL_SIZE = "=w2000"
LARGE_FROM = 400
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/jpg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/gif": "gif",
}


def url_base(c: Column) -> Column:
    return F.substring_index(c, "=", 1)


def _pieces(text: Column, separator: str) -> Column:
    trimmed = F.transform(F.split(text, separator), strip)
    found = F.filter(trimmed, lambda u: u != "")
    none = F.array().cast("array<string>")
    return F.when(text.isin("", "N/A"), none).otherwise(found)


def dedupe_image_urls(c: Column | str, cap: int = DOWNLOAD_CAP) -> Column:
    """The first URL of each base, at most `cap` of them."""
    urls = _pieces(strip(blank(c)), ";")
    return F.slice(keep_first(urls, url_base), 1, cap)


def split_image_urls(c: Column | str) -> Column:
    return _pieces(blank(c), "[,;]")


def cap_images(urls: Column | str, cap: int) -> Column:
    return F.slice(col(urls), 1, cap)


def menu_fullres(c: Column | str) -> Column:
    return F.concat(url_base(col(c)), F.lit(FULL_SIZE))


def ext_for_ctype(c: Column | str) -> Column:
    kind = F.lower(strip(F.substring_index(blank(c), ";", 1)))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.lit("jpg"))


def first_image(c: Column | str) -> Column:
    """Head of a JSON list, else the first of a separated list; other JSON gives ''."""
    text = blank(c)
    parsed = F.try_parse_json(text)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    head = F.coalesce(F.try_variant_get(parsed, "$[0]", "string"), F.lit(""))
    split = F.lit("")
    for mark in (",", "|", ";"):
        split = F.when(
            text.contains(mark), strip(F.substring_index(text, mark, 1))
        ).otherwise(split)
    plain = F.when(split != "", split).otherwise(strip(text))
    return F.when(parsed.isNull(), plain).when(is_list, head).otherwise("")


def safe_name(c: Column | str) -> Column:
    text = F.regexp_replace(strip(blank(c)), r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(filled(text), F.lit("unknown_place"))


def safe_run_id(c: Column | str, limit: int = 64) -> Column:
    """A folder-safe run id; an empty or overlong one is an error."""
    text = F.regexp_replace(strip(c), "[^A-Za-z0-9_-]", "_")
    return (
        F.when(text == "", F.raise_error(F.lit("run id is empty")).cast("string"))
        .when(F.length(text) > limit, F.raise_error(F.lit("run id is too long")).cast("string"))
        .otherwise(text)
    )


def _folder(run: Column | str, place: Column | str) -> Column:
    return F.concat(col(run), F.lit("/"), col(place), F.lit("/"))


def screenshot_name(run, place, kind) -> Column:
    return F.concat(_folder(run, place), F.lit("screenshot_"), col(kind), F.lit(".png"))


def photo_name(run, place, seq, ext) -> Column:
    return F.concat(
        _folder(run, place), col(place), F.lit("_"), col(seq).cast("string"), F.lit("."), col(ext)
    )


def menu_photo_name(run, place, seq) -> Column:
    return F.concat(
        _folder(run, place), col(place), F.lit("_menu_"), col(seq).cast("string"), F.lit(".jpg")
    )


def large_images(urls: Column | str) -> Column:
    """Hosted images whose size suffix asks for a large picture."""
    size = r"=[ws](\d+)"
    return F.filter(
        col(urls),
        lambda u: u.contains("googleusercontent.com")
        & (F.regexp_extract(u, size, 1).try_cast("int") >= LARGE_FROM),
    )


def is_video(caption: Column | str) -> Column:
    return F.coalesce(F.lower(col(caption)).startswith("video"), F.lit(False))


def photo_kind(src: Column | str, caption: Column | str, attribution: Column | str) -> Column:
    """video by caption, street view by host or attribution alone, else photo."""
    no_caption = blank(caption) == ""
    street = blank(src).contains("streetviewpixels") | (no_caption & (blank(attribution) != ""))
    return (
        F.when(is_video(caption), "video")
        .when(blank(src) == "", F.lit(None).cast("string"))
        .when(street, "street_view")
        .otherwise("photo")
    )

"""Place-panel snapshots to typed nested columns, all inside one row.

Every function works on the arrays of a single snapshot, so a panel table is
parsed in one narrow stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegrid.functions.links import LINK_LIMIT, classify_link, is_own_link, unwrap_url
from placegrid.functions.values import blank, col, filled, let, strip

# Weekday names, known currencies and the text patterns of the panel.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
CURRENCIES = (
    "SAR", "AED", "QAR", "KWD", "BHD", "OMR", "JOD", "EGP", "TRY", "ILS",
    "INR", "PKR", "BDT", "LKR", "NPR",
    "USD", "EUR", "GBP", "CHF", "CAD", "AUD", "NZD",
    "IDR", "PHP", "VND", "MYR", "SGD", "THB", "CNY", "JPY", "KRW", "HKD",
    "ZAR", "KES", "NGN", "MAD", "TND", "DZD",
)
BUSY = r"(?i)(\d{1,3})\s*%\s*busy"
USUALLY_BUSY = r"(?i)usually\s+(\d{1,3})\s*%\s*busy"
CLOCK = r"(?i)(\d{1,2})\s*(AM|PM)"
WEEKDAY = r"(?i)(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
PRICE_RANGE = r"(?U)([A-Z]{3}|[^\W\d_]{1,4})\s*([\d,]+)\s*[–\-—]\s*([\d,]+)"
PRICE_SINGLE = r"(?U)([A-Z]{3})\s*([\d,]+)"
PRICE_LINE = r"(?U)^[A-Z]{3}\s[\d,]+(\s*[–\-—]\s*[\d,]+)?\s*\+?\s*…?$"
REPORTED = r"(?U)(?i)Reported by\s+([\d,]+)"
NEGATIVE = r"(?i)^(Does not|Doesn't|No |Not |Isn't|Is not)"
ICON_PREFIX = "(?U)^[\ue000-\uf8ff\\s]+"
CLOSE_ICON = "\ue5cd"
MENU_PRICE = r"(?U)^[A-Z]{3}\s*[\d,]+(\.\d+)?$"
COPY_HOURS = r"(?U)(?i),?\s*Copy open hours\.?$"
UNKNOWN_PREFIX = r"^(?=.{0,2}\p{Lu})[\p{Lu}\p{Lo}\p{Lm}]{3}"
SKIPPED_CHIPS = ("Overview", "Menu", "Reviews", "About")

_NBSP, _NARROW_NBSP = "\u00a0", "\u202f"
_DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")


def _tidy(c: Column) -> Column:
    return strip(F.replace(c, F.lit(_NBSP), F.lit(" ")))


def _amount(c: Column) -> Column:
    digits = F.translate(F.replace(c, F.lit(","), F.lit("")), *_DIGITS)
    return digits.try_cast("double")


def keep_first(rows: Column, key: Callable[[Column], Column]) -> Column:
    """The rows of an array whose key has not appeared earlier in it."""
    def pick(bound: Column) -> Column:
        return let(
            F.transform(bound, key),
            lambda keys: F.filter(bound, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1),
        )

    return let(rows, pick)


def parse_price(lines: Column | str) -> Column:
    """struct<price_range_text,price_min,price_max,price_currency,price_reported_by>."""
    def band(tidy: Column) -> Column:
        reliable = F.filter(
            tidy,
            lambda t: F.lower(t).contains("per person")
            & t.rlike(r"(?U)\d")
            & ~(t.rlike(UNKNOWN_PREFIX) & ~F.substring(t, 1, 3).isin(*CURRENCIES)),
        )
        whole = F.filter(
            tidy, lambda t: t.rlike(PRICE_LINE) & F.substring(t, 1, 3).isin(*CURRENCIES)
        )
        return F.coalesce(F.get(reliable, 0), F.get(whole, 0))

    reported = F.get(F.filter(col(lines), lambda t: t.rlike(REPORTED)), 0)

    def parsed(text: Column) -> Column:
        is_range = text.rlike(PRICE_RANGE)
        single = _amount(F.regexp_extract(text, PRICE_SINGLE, 2))
        currency = F.when(is_range, F.regexp_extract(text, PRICE_RANGE, 1)).otherwise(
            F.regexp_extract(text, PRICE_SINGLE, 1)
        )
        return F.struct(
            text.alias("price_range_text"),
            F.when(is_range, _amount(F.regexp_extract(text, PRICE_RANGE, 2)))
            .otherwise(single).alias("price_min"),
            F.when(is_range, _amount(F.regexp_extract(text, PRICE_RANGE, 3)))
            .otherwise(single).alias("price_max"),
            filled(F.upper(F.substring(currency, 1, 3))).alias("price_currency"),
            _amount(F.regexp_extract(reported, REPORTED, 1)).cast("bigint").alias("price_reported_by"),
        )

    return let(let(F.transform(col(lines), _tidy), band), parsed)


def parse_bar(label: Column | str) -> Column:
    """struct<hour,pct> of a busyness bar, null for any other label."""
    text = col(label)
    pct = F.coalesce(
        filled(F.regexp_extract(text, USUALLY_BUSY, 1)), filled(F.regexp_extract(text, BUSY, 1))
    ).cast("int")
    noon = F.when(F.upper(F.regexp_extract(text, CLOCK, 2)) == "PM", 12).otherwise(0)
    hour = filled(F.regexp_extract(text, CLOCK, 1)).cast("int") % 12 + noon
    return F.when(text.rlike(BUSY), F.struct(hour.alias("hour"), pct.alias("pct")))


def weekday(label: Column | str) -> Column:
    return filled(F.initcap(F.lower(F.regexp_extract(col(label), WEEKDAY, 1))))


def fill_hours(bars: Column) -> Column:
    """Give a bar without an hour the one after its predecessor's, within one day."""
    def at(hours: Column, bar: Column, i: Column) -> Column:
        known = F.array_max(
            F.transform(F.slice(hours, 1, i + 1), lambda h, j: F.when(h.isNotNull(), j))
        )
        hour = let(known, lambda k: (F.get(hours, k) + i - k) % 24)
        return F.struct(
            F.coalesce(bar["hour"], hour).alias("hour"), bar["pct"].alias("pct")
        )

    def all_of(bound: Column) -> Column:
        return let(
            F.transform(bound, lambda b: b["hour"]),
            lambda hours: F.transform(bound, lambda b, i: at(hours, b, i)),
        )

    return let(bars, all_of)


def _bar_rows(day: Column, bars: Column) -> Column:
    return let(
        day,
        lambda d: F.transform(
            bars,
            lambda b: F.struct(
                d.alias("dow"), b["hour"].alias("hour_24"), b["pct"].alias("busy_pct")
            ),
        ),
    )


def popular_days(popular: Column | str) -> Column:
    """Bars of the seven day containers, anchored on the visible one.

    `popular` is struct<days array<array<string>>, visible int, selected string>.
    """
    block = col(popular)
    sunday_first = F.array(*[F.lit(d) for d in (DAYS[-1], *DAYS[:-1])])
    anchor = F.when(
        block["visible"] >= 0,
        F.array_position(sunday_first, weekday(block["selected"])).cast("int") - 1 - block["visible"],
    )

    def one_day(shift: Column, labels: Column, i: Column) -> Column:
        found = F.transform(F.filter(labels, lambda a: a.rlike(BUSY)), parse_bar)
        day = F.get(sunday_first, F.pmod(i + shift, F.lit(7)))
        return F.coalesce(_bar_rows(day, fill_hours(found)), _no_bars())

    bars = let(
        F.coalesce(anchor, F.lit(0)),
        lambda shift: F.flatten(
            F.transform(F.slice(block["days"], 1, 7), lambda labels, i: one_day(shift, labels, i))
        ),
    )
    return F.coalesce(bars, _no_bars())


def _no_bars() -> Column:
    return F.array().cast("array<struct<dow:string,hour_24:int,busy_pct:int>>")


def popular_flat(aria: Column | str, selected: Column) -> Column:
    """Bars of a flat label list; the day comes from the bar's own label or the selector."""
    labels = F.filter(col(aria), lambda a: a.rlike(BUSY))

    def one(label: Column) -> Column:
        return let(
            parse_bar(label),
            lambda b: F.struct(
                F.coalesce(weekday(label), selected).alias("dow"),
                b["hour"].alias("hour_24"), b["pct"].alias("busy_pct"),
            ),
        )

    return F.transform(labels, one)


def selected_day(lines: Column | str, aria: Column | str) -> Column:
    """The first short label that is nothing but a weekday; labels go before lines."""
    texts = F.transform(F.concat(col(aria), col(lines)), lambda t: strip(blank(t)))
    whole = F.filter(
        F.transform(
            F.filter(texts, lambda t: (F.length(t) <= 12) & ~t.rlike(BUSY)),
            lambda t: F.regexp_replace(t, "s+$", ""),
        ),
        lambda t: t.rlike(f"{WEEKDAY}$") & t.rlike(r"(?i)^(Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day$"),
    )
    return weekday(F.get(whole, 0))


def clean_hours_text(label: Column | str) -> Column:
    text = F.translate(col(label), _NARROW_NBSP + _NBSP, "  ")
    text = F.regexp_replace(F.regexp_replace(text, COPY_HOURS, ""), r"(?U)\s+", " ")
    return F.btrim(text, F.lit(" ,."))


def parse_hours(aria: Column | str) -> Column:
    """array<struct<dow,text>>: the first label of each weekday that is not a bar."""
    named = F.filter(col(aria), lambda a: a.rlike(WEEKDAY) & ~a.rlike(BUSY))
    rows = F.transform(
        named, lambda a: F.struct(weekday(a).alias("dow"), clean_hours_text(a).alias("text"))
    )
    return keep_first(rows, lambda r: r["dow"])


def normalize_amenities(rows: Column | str) -> Column:
    """array<struct<section,label>> to distinct array<struct<section,item,present>>."""
    def one(row: Column) -> Column:
        raw = strip(blank(row["label"]))
        item = F.substring(strip(F.regexp_replace(raw, ICON_PREFIX, "")), 1, 120)
        return let(
            item,
            lambda text: F.struct(
                F.substring(strip(blank(row["section"])), 1, 60).alias("section"),
                text.alias("item"),
                (~(raw.startswith(CLOSE_ICON) | text.rlike(NEGATIVE))).alias("present"),
            ),
        )

    whole = F.filter(F.transform(col(rows), one), lambda r: (r["section"] != "") & (r["item"] != ""))
    return keep_first(whole, lambda r: F.struct(r["section"], r["item"]))


def about_items(html: Column | str) -> Column:
    """array<struct<section,label>>: list items under each second-level heading."""
    def plain(c: Column) -> Column:
        return strip(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", ""), r"(?U)\s+", " "))

    def one(block: Column) -> Column:
        items = F.regexp_extract_all(block, F.lit("(?is)(<li[ >].*?</li>)"), F.lit(1))
        return let(
            plain(F.regexp_extract(block, "(?is)^(.*?)</h2>", 1)),
            lambda section: F.transform(
                items,
                lambda li: F.struct(
                    section.alias("section"),
                    F.coalesce(
                        filled(plain(F.regexp_extract(li, '(?is)^<li[^>]*aria-label="([^"]*)"', 1))),
                        plain(li),
                    ).alias("label"),
                ),
            ),
        )

    def below(blocks: Column) -> Column:
        return F.flatten(
            F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), one)
        )

    pairs = let(F.split(col(html), "(?i)<h2[^>]*>"), below)
    return F.filter(pairs, lambda p: (p["section"] != "") & (p["label"] != ""))


def menu_rows(lines: Column | str) -> Column:
    """array<struct<price,name,description>> from stacked name / description / price lines."""
    def one(tidy: Column, ends: Column, end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
        return let(
            F.slice(tidy, start + 1, end - start),
            lambda above: F.struct(
                F.get(tidy, end).alias("price"),
                F.get(above, 0).alias("name"),
                F.get(above, 1).alias("description"),
            ),
        )

    def all_of(tidy: Column) -> Column:
        places = F.transform(tidy, lambda t, i: F.when(t.rlike(MENU_PRICE), i))
        return let(
            F.filter(places, lambda i: i.isNotNull()),
            lambda ends: F.transform(ends, lambda end, k: one(tidy, ends, end, k)),
        )

    rows = let(F.filter(F.transform(col(lines), _tidy), lambda t: t != ""), all_of)
    named = F.filter(rows, lambda r: r["name"].isNotNull())
    return keep_first(named, lambda r: F.struct(r["name"], r["price"]))


def normalize_menu(rows: Column | str) -> Column:
    """Priced, named rows as array<struct<name,description,currency,price_amount>>."""
    begins = r"(?U)^([A-Z]{3})\s*([\d,]+)"

    def one(row: Column) -> Column:
        return let(
            _tidy(blank(row["price"])),
            lambda price: F.struct(
                F.substring(strip(blank(row["name"])), 1, 200).alias("name"),
                filled(F.substring(strip(blank(row["description"])), 1, 500)).alias("description"),
                F.regexp_extract(price, begins, 1).alias("currency"),
                _amount(F.regexp_extract(price, begins, 2)).alias("price_amount"),
            ),
        )

    return F.filter(
        F.transform(col(rows), one), lambda r: (r["name"] != "") & r["price_amount"].isNotNull()
    )


def outbound_links(links: Column | str) -> Column:
    """array<struct<kind,url>>: distinct real targets outside the maps site."""
    real = F.filter(
        F.transform(col(links), unwrap_url), lambda u: u.isNotNull() & ~is_own_link(u)
    )
    return F.transform(
        F.array_distinct(real),
        lambda u: F.struct(
            classify_link(u).alias("kind"), F.substring(u, 1, LINK_LIMIT).alias("url")
        ),
    )

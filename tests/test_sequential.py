"""Window forms against plain loops over random groups."""

import math
import random

from pyspark.sql import functions as F

from placegrid.operators import discovery as C
from placegrid.operators import grid as Z
from placegrid.operators import keys as K
from placegrid.operators import media as G
from placegrid.operators import monitor as M
from placegrid.operators import ordered as R
from placegrid.operators import panel as N


def test_pagination(spark):
    rng, rows, want = random.Random(7), [], {}
    for call in range(400):
        pool, pages = rng.choice([4, 12, 200]), rng.randint(1, 9)
        seen, low, sat, empty, stop = set(), 0, 0, 0, None
        for page in range(1, pages + 1):
            ids = [f"p{rng.randrange(pool)}" for _ in range(rng.choice([0, 0, 3, 20]))]
            more, status = page < pages or rng.random() < 0.2, 500 if rng.random() < 0.03 else 200
            rows += [(str(call), "q", 1, page, status, False, len(ids), ids, more)] * rng.choice([1, 1, 2])
            if stop:
                continue
            new = len(set(ids) - seen)
            seen |= set(ids)
            empty = empty + 1 if not ids else 0
            low = low + 1 if new < 3 else 0
            sat = sat + 1 if (new / len(ids) if ids else 0) < 0.15 else 0
            for hit, why in ((status != 200, None), (not more, None), (page >= 6, "max_pages"), (empty >= 2, "empty_streak"),
                             (page >= 3 and low >= 2, "low_yield"), (sat >= 2, "saturation")):
                if hit:
                    stop = (page, why)
                    break
        want[str(call)] = stop or (pages, None)
    schema = "cell_id string, query string, attempt int, page int, status int, auth_failed boolean, results int, ids array<string>, has_next boolean"
    pages = spark.createDataFrame(rows, schema).filter("page <= 6").groupBy(*C.CALL, "page").agg(
        *[F.first(c).alias(c) for c in ("status", "auth_failed", "results", "ids", "has_next")]
    )
    got = {r.cell_id: (r.stop_page, r.stop_reason) for r in C.paginate(pages).collect()}
    assert got == want


def test_gallery(spark):
    rng, rows, want = random.Random(8), [], set()
    for place in range(200):
        seen, stale, out = set(), 0, 0
        over = False
        for step in range(rng.randint(1, 40)):
            img = rng.choice([None, f"http://i/{rng.randrange(30)}=w{step}", "http://streetviewpixels/1"])
            cap, attr = rng.choice([None, "Photo - Jun", "Video - Jul"]), rng.choice([None, "Image capture: May"])
            rows.append((str(place), step, img, None, cap, attr))
            if over or step >= 24:
                continue
            video = bool(cap and cap.startswith("Video"))
            src = None if video else img
            sig = (cap, (src or "").split("=")[0])
            if sig in seen:
                stale += 1
                over = stale >= 3
                continue
            seen.add(sig)
            stale = 0
            if video or src:
                kind = "video" if video else "street_view" if "streetview" in src or (not cap and attr) else "photo"
                want.add((str(place), step, kind))
                out += 1
                over = out >= 12
    schema = "place_id string, step int, img string, vid string, cap string, attr string"
    got = {(r.place_id, r.step, r.kind) for r in G.walk_gallery(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_throttle_over_chunks(spark):
    rng, rows, want = random.Random(9), [], {}
    for key in range(4):
        streak = hits = 0
        for i in range(300 if key else 3000):           # the first key holds most calls
            status, auth = rng.choice([(429, False)] * 5 + [(200, False), (403, True), (500, False)])
            if status == 429:
                streak, hits = streak + 1, hits + 1
            elif not auth:
                streak = 0
            rows.append((f"k{key}", i, status, auth))
            want[(f"k{key}", i)] = (status == 429 and streak % 2 == 0, hits)
    calls = spark.createDataFrame(rows, "alias string, at int, status int, auth_failed boolean")
    got = K.throttle_streaks(calls, ["at"], F.floor(F.col("at") / 13)).collect()
    assert {(r.alias, r.at): (r.parked, r.rate_limit_hits) for r in got} == want


def test_menu_walk(spark):
    rng, rows, want = random.Random(10), [], set()
    for place in range(150):
        seen, empty = set(), 0
        for pos in range(rng.randint(1, 14)):
            chip = None if pos == 0 else rng.choice(["Menu", "x" * 41, "", f"chip{pos}", f"chip{pos}", f"chip{pos}"])
            items = [(f"n{rng.randrange(12)}", None, "SAR", float(rng.randrange(2))) for _ in range(rng.choice([0, 1, 3]))]
            rows.append((str(place), pos, chip, items))
            if chip is not None and (chip in ("", "Menu") or len(chip) > 40 or empty >= 3):
                continue
            fresh = {(n, p) for n, _, _, p in items} - seen
            empty = 0 if fresh or chip is None else empty + 1
            seen |= fresh
            want |= {(str(place), pos, n, p) for n, p in fresh}
    schema = ("place_id string, chip_pos int, chip string, "
              "items array<struct<name:string,description:string,currency:string,price_amount:double>>")
    got = N.walk_menu(spark.createDataFrame(rows, schema)).collect()
    assert {(r.place_id, r.chip_pos, r.name, r.price_amount) for r in got} == want


def test_scroll_plateau(spark):
    rng, rows, want = random.Random(11), [], {}
    for cell in range(150):
        seen, last, flat, stop, pool = set(), -1, 0, None, rng.choice([3, 30])
        for r in range(8):
            ids = {f"i{rng.randrange(pool)}" for _ in range(rng.choice([0, 1, 4]))} if r else {"i0"}
            rows += [(str(cell), "q", r, i) for i in ids]
            if stop is None:
                seen |= ids
                flat = flat + 1 if len(seen) == last else 0
                last = len(seen)
                stop = r if flat >= 2 else None
        want[str(cell)] = len(seen)
    harvest = spark.createDataFrame(rows, "cell_id string, query string, round int, place_id string")
    got = C.scroll_plateau(harvest).groupBy("cell_id").count().collect()
    assert {r["cell_id"]: r["count"] for r in got} == want


def test_scans_match_plain_loops_with_a_hot_key(spark):
    rng = random.Random(12)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.randrange(100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    chunk = F.floor(F.col("at") / 100)
    total, index, before = {}, {}, {}
    sums, counts, last = {}, {}, {}
    for k, at, v in rows:
        sums[k] = sums.get(k, 0) + v
        total[at], index[at], before[at] = sums[k], counts.get(k, 0), last.get(k)
        counts[k], last[k] = index[at] + 1, v
    assert {r["at"]: r["s"] for r in R.running_sum(df, ["k"], chunk, ["at"], F.col("v"), "s").collect()} == total
    assert {r["at"]: r["i"] for r in R.row_index(df, ["k"], chunk, ["at"], "i").collect()} == index
    assert {r["at"]: r["p"] for r in R.previous(df, ["k"], chunk, ["at"], F.col("v"), "p").collect()} == before


def test_bounded_tail_limits(spark):
    events = spark.range(900).select(
        "id", *[F.lit("").alias(c) for c in ("ts", "level", "name", "phase", "cell_id", "place_id")], F.lit("m").alias("msg")
    )
    assert M.bounded_tail(events, ["id"]).count() == 500
    long = events.withColumn("msg", F.repeat(F.lit("é"), 3000))
    row = M.bounded_tail(long, ["id"]).agg(F.count("*").alias("n"), F.max(F.length("msg")).alias("l")).first()
    assert row.l == 2003 and 60 < row.n < 70


def test_rings_that_cross_themselves(spark):
    """Random rings against every pair of their edges, on a coarse lattice so that touches and spikes come up."""
    rng, rows, want = random.Random(21), [], {}

    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    def crossed(ring):
        ring = [p for p, q in zip(ring, ring[1:] + ring[:1]) if p != q]
        es = list(zip(ring, ring[1:] + ring[:1]))
        for i, (a, b) in enumerate(es):
            for j in range(i + 1, len(es)):
                c, d = es[j]
                if j - i == 1 or j - i == len(es) - 1:
                    flat = side(a, b, c) == 0 and side(a, b, d) == 0
                    if flat and (b[0] - a[0]) * (d[0] - c[0]) + (b[1] - a[1]) * (d[1] - c[1]) < 0:
                        return True
                elif side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0 and all(
                        max(a[k], b[k]) >= min(c[k], d[k]) and max(c[k], d[k]) >= min(a[k], b[k]) for k in (0, 1)):
                    return True
        return False

    for b in range(220):
        size = rng.choice([3, 4, 5, 6, 60])
        ring = [(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(size)]
        if size == 60:  # around a centre, so that it is simple as often as not
            ring = [(64 + round(50 * math.cos(a / 60 * 6.28)), 64 + round(50 * math.sin(a / 60 * 6.28))) for a in range(60)]
            if b % 2:
                ring[7], ring[30] = ring[30], ring[7]
        if b % 3 == 0:
            ring.append(ring[0])  # closed
        rows.append((str(b), [[(float(x), float(y)) for x, y in ring]]))
        want[str(b)] = len(ring) >= 3 and not crossed([(y, x) for x, y in ring])
    rows += [("none", []), ("short", [[(0.0, 0.0), (1.0, 1.0)]])]
    want |= {"none": False, "short": False}
    df = spark.createDataFrame(rows, "boundary_id string, rings array<array<struct<lat:double,lng:double>>>")
    got = {r.boundary_id: r.valid for r in Z.rings_valid(df).collect()}
    assert got == want and 40 < sum(want.values()) < 180

"""Distributed helpers against plain computations on random rows."""

import datetime as dt
import math
import random
from decimal import Decimal as D

import pytest
from conftest import NOW, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridelake.functions.geo import cosine_km
from ridelake.operators import lifecycle, matching
from ridelake.plans import keyed
from ridelake.plans.grid import join_within
from ridelake.plans.keyed import join_per_key, left_join_many, neighbours, running_totals, top_per_key
from ridelake.schema import EARTH_RADIUS_KM
from ridelake.sources.ingest import ingest_registrations


def _points(seed, n, poles=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:  # one busy spot
            out.append((i, 24.86 + rng.uniform(-0.05, 0.05), 67.0 + rng.uniform(-0.05, 0.05)))
        elif kind == 1:  # around the date line
            out.append((i, rng.uniform(-5, 5), rng.choice([179.9, -179.9]) + rng.uniform(-0.1, 0.1)))
        elif kind == 2 and poles:
            out.append((i, rng.choice([-1, 1]) * rng.uniform(88, 90), rng.uniform(-180, 180)))
        else:
            out.append((i, rng.uniform(-90, 90), rng.uniform(-180, 180)))
    return [(i, max(-90.0, min(90.0, la)), (lo + 540) % 360 - 180) for i, la, lo in out]


def _km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("reach", [0.5, 10, 50, 700, 6000])
def test_grid_join_finds_all_pairs_once(spark, reach):
    points, sites = _points(1, 150), _points(2, 120)
    pairs = join_within(
        spark.createDataFrame(points, "p BIGINT, plat DOUBLE, plng DOUBLE"),
        spark.createDataFrame(sites, "s BIGINT, slat DOUBLE, slng DOUBLE"),
        ["p"], ("plat", "plng"), ("slat", "slng"), reach_km=reach, pairs_per_split=40,
    ).select("p", "s").collect()
    got = {(r.p, r.s) for r in pairs}
    assert len(got) == len(pairs)
    expected = {(a[0], b[0]) for a in points for b in sites if _km(a, b) <= reach}
    assert expected <= got


@pytest.mark.parametrize(("n_points", "n_sites"), [(1, 40_000), (40_000, 1), (400, 400)])
def test_both_sides_of_a_busy_cell_are_split(spark, n_points, n_sites):
    def spots(n, name):
        return spark.range(n).select(F.col("id").alias(name), F.lit(24.86).alias(f"{name}lat"), F.lit(67.0).alias(f"{name}lng"))

    pairs = join_within(
        spots(n_points, "p"), spots(n_sites, "s"), ["p"], ("plat", "plng"), ("slat", "slng"), reach_km=10, pairs_per_split=400,
    )
    per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == n_points * n_sites
    assert max(per_task) < sum(per_task) / 2


def test_nearest_matches_brute_force(spark, seed):
    places, pickups = _points(3, 60, poles=False), _points(4, 80, poles=False)
    cut7 = lambda v: D(f"{v:.7f}")
    drivers = spark.createDataFrame(
        [(i, i, f"{i}", f"{i}", None, "verified", "available" if i % 5 else "busy", D("4"), 1) for i, _, _ in places],
        seed["driver"].schema,
    )
    pings = spark.createDataFrame([(i, i, cut7(a), cut7(b), NOW) for i, a, b in places], seed["driver_location"].schema)
    requests = spark.createDataFrame(
        [(i, cut7(a), cut7(b)) for i, a, b in pickups], "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)"
    )
    got = {r.request_id: (r.driver_id, r.distance_km) for r in matching.nearest_driver(
        seed.replace(driver=drivers, driver_location=pings), requests).collect()}
    both = requests.crossJoin(pings.where("driver_id % 5 <> 0")).withColumn(
        "km", F.round(cosine_km(*[F.col(c) for c in ("pickup_lat", "pickup_lng", "latitude", "longitude")]), 2).cast("decimal(10,2)")
    )
    want = {r.request_id: (r.best.driver_id, r.best.km) for r in both.groupBy("request_id").agg(
        F.min(F.struct("km", "driver_id")).alias("best")).collect()}
    assert got == want


def _bookable(spark, seed, places):
    """Seed tables with a bookable driver per place; ratings repeat, one in five is busy."""
    cut7 = lambda v: D(f"{v:.7f}")
    frames = {
        "users": [(i, "a", "b", f"{i}", f"{i}", "driver", "active", D("0"), None, NOW) for i, _, _ in places],
        "driver": [(i, i, f"{i}", f"{i}", None, "verified", "available" if i % 5 else "busy", D(i % 3), 1) for i, _, _ in places],
        "vehicles": [(i, i, f"{i}", "m", "n", 2020, "red", "economy", "verified", 1) for i, _, _ in places],
        "driver_location": [(i, i, cut7(a), cut7(b), NOW) for i, a, b in places],
    }
    return seed.replace(**{name: spark.createDataFrame(data, seed[name].schema) for name, data in frames.items()})


@pytest.mark.parametrize("k", [1, 4, 40])
def test_closest_drivers_are_the_first_within_the_radius(spark, seed, k):
    places = _points(7, 150)
    places += [(200 + i, 24.86, 67.0) for i in range(60)]  # a depot
    places += [(300 + i, 24.86 + i * 1e-5, 67.0) for i in range(60)]  # a rank
    pickups = [*_points(8, 80), (500, 24.86, 67.0), (501, 24.86, 67.0), (502, 24.9, 67.0)]
    t = _bookable(spark, seed, places)
    requests = spark.createDataFrame(
        [(i, D(f"{a:.7f}"), D(f"{b:.7f}")) for i, a, b in pickups], "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)"
    )
    window = Window.partitionBy("request_id").orderBy("distance_km", F.desc_nulls_last("average_rating"), "driver_id")
    want = matching.drivers_within_radius(t, requests).withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
    got = matching.closest_drivers(t, requests, k)
    assert rows(got, "request_id", "place", "driver_id", "distance_km") == rows(want, "request_id", "place", "driver_id", "distance_km")
    assert got.count() > 80 * min(k, 2) / 4


def test_closest_drivers_make_pairs_by_k_not_by_density(spark, seed, monkeypatch):
    made = []

    def counted(*args, **kw):
        pairs = join_within(*args, **kw)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(matching, "join_within", counted)
    rng = random.Random(3)
    t = _bookable(spark, seed, [(i, 24.8 + rng.uniform(0, 0.2), 67.0 + rng.uniform(0, 0.2)) for i in range(4000)])
    requests = spark.createDataFrame(
        [(i, D(f"{24.8 + rng.uniform(0, 0.2):.7f}"), D(f"{67.0 + rng.uniform(0, 0.2):.7f}")) for i in range(200)],
        "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)",
    )
    assert matching.closest_drivers(t, requests, 3).count() == 600
    assert sum(made) < 200 * 4000 * 0.8 / 10


def test_closest_drivers_without_drivers(spark, seed):
    none = seed.replace(driver=seed["driver"].where("driver_id < 0"))
    requests = spark.createDataFrame([(1, D("1"), D("2"))], "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)")
    assert matching.closest_drivers(none, requests, 3).count() == 0
    assert matching.closest_drivers(seed, requests.limit(0), 3).count() == 0


def test_nearest_without_drivers(spark, seed):
    none = seed.replace(driver=seed["driver"].where("driver_id < 0"))
    requests = spark.createDataFrame([(1, D("1"), D("2"))], "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)")
    assert rows(matching.nearest_driver(none, requests)) == [(1, None, None)]


@pytest.fixture(params=[1, 100, keyed.MIN_HOT_ROWS], ids=["all hot", "some hot", "none hot"])
def heat(request, monkeypatch):
    monkeypatch.setattr(keyed, "MIN_HOT_ROWS", request.param)


@pytest.fixture(scope="module")
def feed(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = None if rng.random() < 0.05 else (1 if rng.random() < 0.4 else rng.randrange(2, 40))
        data.append((i, key, rng.randrange(-3, 6), NOW + dt.timedelta(seconds=rng.randrange(0, 400_000, 7))))
    return spark.createDataFrame(data, "id BIGINT, key BIGINT, v BIGINT, ts TIMESTAMP_NTZ").withColumn("k", F.struct("key"))


@pytest.mark.parametrize("minutes", [7, 100_000])
def test_running_totals_equal_one_window(feed, heat, minutes):
    got = running_totals(feed, ["k"], ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)}, minutes)
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = feed.select("id", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    assert rows(got, "id", "s", "n") == rows(want, "id", "s", "n")


def test_starting_values(spark, feed, heat):
    start = feed.where("key % 2 = 0").groupBy("k").agg(F.max("v").alias("v"), F.max("v").alias("s"))
    shift = feed.join(start.select("k", F.col("s").alias("s0"), F.col("v").alias("v0")), "k", "left")
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = shift.select(
        "id", (F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("s0", F.lit(0))).alias("s"),
        F.coalesce(F.lag("v").over(w), "v0").alias("pv"),
    )
    got = running_totals(feed, ["k"], ["ts", "id"], {"s": F.col("v")}, 30, initial=start)
    assert rows(got, "id", "s") == rows(want, "id", "s")
    got = neighbours(feed, ["k"], ["ts", "id"], {"pv": "v"}, slice_minutes=30, initial=start)
    assert rows(got, "id", "pv") == rows(want, "id", "pv")


@pytest.mark.parametrize("minutes", [7, 100_000])
def test_neighbours_equal_lag_and_lead(feed, heat, minutes):
    got = neighbours(feed, ["k"], ["ts", "id"], {"pv": "v"}, {"nid": "id"}, minutes)
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = feed.select("id", F.lag("v").over(w).alias("pv"), F.lead("id").over(w).alias("nid"))
    assert rows(got, "id", "pv", "nid") == rows(want, "id", "pv", "nid")


def test_top_per_key(feed):
    got = top_per_key(feed.where("key IS NOT NULL"), ["key"], [F.desc("v"), F.asc("id")], 3)
    best = {}
    for r in feed.where("key IS NOT NULL").collect():
        best.setdefault(r.key, []).append((-r.v, r.id))
    want = sorted((k, i) for k, items in best.items() for _, i in sorted(items)[:3])
    assert rows(got, "key", "id") == sorted(want, key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_per_key_equals_a_join(feed, heat, how):
    some = feed.select("id", "key", "v")
    names = some.where("key IS NOT NULL AND key % 7 <> 3").groupBy("key").agg(F.max("v").alias("best"))
    got = join_per_key(some, names, ["key"], how)
    assert got.columns == ["key", "id", "v", "best"]
    assert rows(got, "id", "key", "v", "best") == rows(some.join(names, "key", how), "id", "key", "v", "best")


def test_left_join_many_equals_a_left_join(feed, heat):
    many = feed.select("key", F.col("id").alias("other")).where("key IS NULL OR key % 3 <> 1")
    some = feed.select("key", "v").where("key IS NULL OR key % 5 <> 2").distinct()
    got = left_join_many(some, some.select("key").distinct(), many, ["key"])
    assert got.columns == ["key", "v", "other"]
    assert rows(got, "key", "v", "other") == rows(some.join(many, "key", "left"), "key", "v", "other")


def test_hot_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MIN_HOT_ROWS", 500)
    some = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"), "id")
    assert list(keyed.hot_keys(some, ["key"]).values()) == [10_000]
    names = some.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = join_per_key(some, names, ["key"], "inner")
    assert out.where("key = -1").count() == 10_000 and out.count() == 30_000
    assert keyed.hot_keys(some.limit(0), ["key"]) == {}


def test_settlement_matches_a_sequential_loop(spark, seed, heat):
    """Requests of few rides: some come twice, some lack their ride, user, method or time."""
    rng = random.Random(11)
    statuses = {i: rng.choice(["completed", "completed", "cancelled", None]) for i in range(1, 30)}
    ride_rows = [r for r in seed["rides"].limit(1).collect()]
    rides = spark.createDataFrame(
        [tuple((ride_rows[0].asDict() | {"ride_id": i, "user_id": i % 4 if i % 9 else None, "driver_id": 1 if i % 5 else None,
                "ride_status": status, "fare": D(i * 10)}).values()) for i, status in statuses.items()], seed["rides"].schema)
    owner = {i: i % 4 if i % 9 else None for i in statuses}
    paid = {5, 6, 14}
    pay = seed["payments"].first().asDict()
    payments = spark.createDataFrame(
        [tuple((pay | {"payment_id": i, "ride_id": i if i < 20 else None, "payment_status": "paid" if i in paid or i >= 20 else "pending"}).values())
         for i in range(1, 23)], seed["payments"].schema)
    codes = {"welcome50": (1, D(50)), "save100": (2, D(100)), "ride25": (3, D(25))}
    data = []
    for i in range(600):
        ride = None if i % 40 == 0 else 1 if i % 3 == 0 else rng.randrange(1, 32)
        user = owner.get(ride) if rng.random() < 0.8 else rng.choice([None, 1, 3])
        when = None if i % 50 == 7 else NOW + dt.timedelta(seconds=rng.randrange(0, 40_000, 9))
        data.append((i, ride, user, rng.choice(["cash", "card", "gold", None]), rng.choice([None, "", " Save100 ", "RIDE25", "NOPE"]), when))
    data += data[:60]
    requests = spark.createDataFrame(
        data, "request_id BIGINT, ride_id BIGINT, user_id BIGINT, payment_method STRING, promo_code STRING, requested_at TIMESTAMP_NTZ")
    settled, want = set(), []
    for i, ride, user, method, code, when in sorted(data, key=lambda r: (r[5] is not None, r[5] or NOW, r[0])):
        known = ride in statuses and user is not None and owner[ride] == user
        promo = codes.get(code.strip().lower()) if code else None
        reason = ("invalid_method" if method not in ("cash", "card") else "ride_not_found" if not known
                  else "not_completed" if statuses[ride] not in ("completed", None) else "already_paid" if ride in paid else None)
        if reason is None:
            reason = "already_paid" if ride in settled else "invalid_promo" if code and not promo else None
        if reason is None:
            settled.add(ride)
        amount = max(D(0), (D(ride * 10) if known else D(0)) - (promo[1] if promo else 0)) if known and not (code and not promo) else None
        want.append((i, ride, reason, promo and promo[0], amount))
    out = lifecycle.settle_payments(requests, rides, payments, seed["promo_code"], "2026-03-10")
    assert rows(out["decided"], "request_id", "ride_id", "reject_reason", "promo_id", "amount") == sorted(want, key=repr)
    assert out["payments"].count() == len(settled) > 5
    assert sorted(r.ride_id for r in out["history"].collect()) == sorted(r for r in settled if r % 5)


def test_registrations_match_a_sequential_loop(spark, seed, heat):
    rng = random.Random(6)
    data = [(i, f"e{rng.randrange(60)}", f"p{rng.randrange(60)}", NOW + dt.timedelta(seconds=rng.randrange(500))) for i in range(300)]
    data += [(1000 + i, "hot", f"h{i}", NOW) for i in range(100)]
    raw = spark.createDataFrame(data, "request_id BIGINT, email STRING, phone_number STRING, submitted_at TIMESTAMP_NTZ").select(
        "*", *[F.lit("v").alias(c) for c in ("fname", "lname", "cnic", "license_number")], F.lit("rider").alias("role")
    )
    taken_e, taken_p, want = set(), set(), []
    for i, e, p, _ in sorted(data, key=lambda r: (r[3], r[0])):
        if e not in taken_e and p not in taken_p:
            want.append((i,))
            taken_e.add(e)
            taken_p.add(p)
    assert rows(ingest_registrations(raw, seed["users"])["users"], "user_id") == sorted(want, key=repr)


def test_actions_match_a_state_machine(spark, seed, heat):
    rng = random.Random(7)
    states = ["requested", "accepted", "in_progress", "completed", "cancelled"]
    start = {i: rng.choice(states) for i in range(1, 31)}
    rides = spark.createDataFrame(
        [(i, 2, 1, 1, 1, 2, NOW, None, None, None, s, D("1")) for i, s in start.items()], seed["rides"].schema
    )
    data = []
    for i in range(900):
        action = rng.choice(["accept", "reject", "cancel", "cancel", "reject"])
        actor = rng.choice([4, 2]) if rng.random() < 0.3 else (2 if action == "cancel" else 4)
        ride = 1 if rng.random() < 0.4 else rng.randrange(1, 31)
        data.append((i, ride, action, actor, NOW + dt.timedelta(minutes=rng.randrange(600))))
    requests = spark.createDataFrame(
        data, "action_id BIGINT, ride_id BIGINT, action STRING, actor_user_id BIGINT, acted_at TIMESTAMP_NTZ"
    )
    state, done = dict(start), set()
    for i, ride, action, actor, _ in sorted(data, key=lambda r: (r[4], r[0])):
        if actor != (2 if action == "cancel" else 4):
            continue
        if action == "accept":
            state[ride] = "accepted"
        elif action == "reject" and state[ride] == "requested":
            state[ride] = "rejected_by_driver"
        elif action == "cancel" and state[ride] in ("requested", "accepted"):
            state[ride] = "cancelled"
        else:
            continue
        done.add(i)
    out = lifecycle.accept_reject_cancel(requests, rides, seed["driver"])
    assert {r.action_id for r in out["decided"].where("reject_reason IS NULL").collect()} == done
    assert rows(out["rides"], "ride_id", "ride_status") == sorted(state.items(), key=repr)


def test_shares_add_up(tables):
    from ridelake.operators import aggregates, ranked

    daily = aggregates.platform_revenue(tables)
    assert daily.where("platform_commission + driver_payouts <> gross_revenue").count() == 0
    total = aggregates.platform_summary(tables).first().total_revenue
    assert ranked.payment_method_breakdown(tables).agg(F.sum("total_amount")).first()[0] == total
    assert aggregates.revenue_by_city(tables).agg(F.sum("total_revenue")).first()[0] == total

"""Known answers of small cases, and rules that SQL can't state."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from stratiq import streaming
from stratiq.functions import circular, numeric, spectral
from stratiq.operators import decision as D, geometry as G, hydrology, models as M, raster, relational as R, segmentation, signatures as S, stats, temporal
from stratiq.plans import queries
from stratiq.sources import sinks, stations

DATA = "/root/testdata/sf0.001"


def one(df):
    return df.first()[0]


def test_entropy_and_richness(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 3.0)], "seg int, c string, w double")
    rows = {r["seg"]: r for r in S.entropy(df, "seg", "c", "w").collect()}
    assert rows[1]["H"] == pytest.approx(math.log(2)) and rows[1]["H_norm"] == pytest.approx(1)
    assert rows[2]["H"] == pytest.approx(0) and rows[2]["H_norm"] is None


@pytest.mark.parametrize(("pairs", "expected"), [([("a", "a"), ("b", "b")] * 2, math.log(2)), ([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")], 0.0)])
def test_mutual_information(spark, pairs, expected):
    df = spark.createDataFrame([(1, *p) for p in pairs], "k int, a string, b string")
    assert S.mutual_information(df, ["k"], "a", "b").first()["I"] == pytest.approx(expected, abs=1e-12)


def test_adjusted_rand(spark):
    same = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    flat = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int")
    assert one(stats.adjusted_rand(same, "a", "b")) == pytest.approx(1)
    assert one(stats.adjusted_rand(flat, "a", "b")) is None


@pytest.mark.parametrize(("angles", "expected"), [((350.0, 10.0), 0.0), ((90.0, 180.0), 135.0)])
def test_circular_mean(spark, angles, expected):
    got = one(spark.createDataFrame([(a,) for a in angles], "a double").agg(circular.circular_mean("a")))
    assert min(abs(got - expected), 360 - abs(got - expected)) < 1e-9


def test_sector(spark):
    df = spark.createDataFrame([(0.0,), (29.9,), (30.0,), (360.0,), (-999.0,)], "a double")
    assert [r[0] for r in df.select(numeric.sector("a")).collect()] == [0, 0, 1, 11, None]


def test_unit_range(spark):
    df = spark.createDataFrame([(2.0, 3.0), (4.0, 3.0), (6.0, 3.0)], "a double, b double")
    rows = R.unit_range(df, ["a", "b"]).orderBy("a").collect()
    assert [r["a_n"] for r in rows] == [0, 0.5, 1] and [r["b_n"] for r in rows] == [None] * 3


def test_mode_tie_goes_to_the_smallest(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "k int, v int, w double")
    assert tuple(S.mode_share(df, "k", "v", "w").first()) == (1, 1, 0.5)


def test_southness(spark):
    df = spark.createDataFrame([(180.0,), (0.0,), (90.0,)], "a double")
    assert [round(r[0], 9) for r in df.select(circular.southness("a")).collect()] == [1, 0, 0.5]


def test_thinning_keeps_in_order(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 6.0, 0.0)], "id long, x double, y double")
    assert sorted(r["id"] for r in G.thin(df, "id", ["id"], 5.0).collect()) == [1, 3]


def test_thinning_equals_the_sequential_rule(spark):
    points = [(i, float(i * 7919 % 1000), float(i * 104729 % 1000)) for i in range(300)]
    kept = []
    for i, x, y in points:
        if all(math.hypot(x - a, y - b) > 60 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(points, "id long, x double, y double")
    assert sorted(r["id"] for r in G.thin(df, "id", ["id"], 60.0).collect()) == [k[0] for k in kept]


@pytest.mark.parametrize(("votes", "k"), [((6, 6, 9, 40), 6), ((5, 7, 9), 7)])
def test_vote(spark, votes, k):
    assert one(stats.vote(spark.createDataFrame([(v,) for v in votes], "k int"), "k", 4, 25)) == k


def test_score_is_null_with_a_null_term(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, None), (3, 2.0, 3.0)], "id int, a double, b double")
    scored = {r["id"]: r["mcda_score"] for r in D.mcda(df, {"a": 0.5, "b": 0.5}).collect()}
    assert scored == {1: 0.0, 2: None, 3: 1.0}
    assert [r["id"] for r in D.lowest(D.mcda(df, {"a": 0.5, "b": 0.5}), "mcda_score", "id", 5).collect()] == [1, 3]


def test_condition_must_be_boolean(spark):
    df = spark.range(3)
    assert R.filter_text(df, " ").count() == 3 and R.filter_text(df, "id > 0").count() == 2
    with pytest.raises(ValueError, match="not a condition"):
        R.filter_text(df, "id + 1")


def test_attach_renames_or_refuses_clashes(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 3)], "k int, v int")
    assert R.attach(a, b, "k").columns == ["k", "v", "v__dup"]
    with pytest.raises(ValueError, match="both sides"):
        R.attach(a, b, "k", strict=True)


def test_indices(spark):
    df = spark.createDataFrame([(0.6, 0.2, 0.1), (0.0, 0.0, 0.0)], "n double, r double, b double")
    first, zero = df.select(spectral.ndvi("n", "r"), spectral.savi("n", "r"), spectral.kndvi("n", "r")).collect()
    assert first[0] == pytest.approx(0.5) and first[1] == pytest.approx(0.6 / 1.3) and first[2] == pytest.approx(math.tanh(0.25))
    assert zero[0] is None


def test_strahler(spark):
    # Two sources meet (2), a source joins (still 2), another 2 joins (3).
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (6, 8), (7, 8), (5, 9), (8, 9)], "src long, dst long")
    orders = {r["id"]: r["strahler"] for r in hydrology.strahler(edges).collect()}
    assert orders == {1: 1, 2: 1, 4: 1, 6: 1, 7: 1, 3: 2, 5: 2, 8: 2, 9: 3}


def test_patches_of_eight_neighbours(spark):
    cells = [(0, 0, "x"), (1, 1, "x"), (0, 2, "y"), (5, 5, "x")]
    got = {(r["row"], r["col"]): r["component"] for r in raster.patches(spark.createDataFrame(cells, "row long, col long, c string"), "c", 10).collect()}
    assert got == {(0, 0): 0, (1, 1): 0, (0, 2): 2, (5, 5): 55}


def test_hulls_hold_all_points(spark):
    df = spark.createDataFrame([("g", float(i * 37 % 101), float(i * 53 % 97)) for i in range(400)], "g string, x double, y double")
    hull = [(r["x"], r["y"]) for r in G.convex_hulls(df, "g", "x", "y").orderBy("i").collect()]
    for r in df.collect():
        assert all((b[0] - a[0]) * (r["y"] - a[1]) - (b[1] - a[1]) * (r["x"] - a[0]) >= -1e-9 for a, b in zip(hull, [*hull[1:], hull[0]], strict=True))


def test_break_is_found_where_it_is(spark):
    rows = [(k, m, 10 + 3 * math.sin(2 * math.pi * m / 12) + 0.1 * ((m * 7919) % 13 - 6) / 6 + (5.0 if k == "b" and m >= 60 else 0.0)) for k in "ab" for m in range(84)]
    got = {r["k"]: r for r in M.break_detection(spark.createDataFrame(rows, "k string, m int, v double"), "k", "m", "v", 48).collect()}
    assert got["a"]["break_month"] is None and 60 <= got["b"]["break_month"] <= 63 and got["b"]["magnitude"] > 2


def test_strata_attach_to_all(spark):
    rows = [(i, float(i % 3 * 10) + i * 1e-3, None if i % 10 == 0 else float(i % 3)) for i in range(60)]
    out = M.strata(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], 3, 2)
    assert out.count() == 60 and out.filter("stratum is null").count() == 6 and out.filter("candidate").count() == 6


def test_mean_shift_separates_levels(spark):
    cells = [(r, c, (100.0 if c < 5 else 10.0) + (r + c) % 2) for r in range(6) for c in range(10)]
    out = segmentation.mean_shift(spark.createDataFrame(cells, "row long, col long, z double"), "z", 1, 20.0, 10)
    assert out.select("segment").distinct().count() == 2


def test_row_ids_are_dense(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    assert all(r["id"] == r["k"] + 1 for r in R.row_ids(df, "k").collect())


def test_stream_equals_batch(spark):
    stream = queries()["hourly_stream"](spark, DATA)
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ws"))
    batch = temporal.tumbling(events, "ts", "1 hour")
    key = lambda df: sorted((str(r["start"]), r["n"], round(r["mean_ws"], 6)) for r in df.collect())
    assert key(stream) == key(batch)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    """Two runs over a folder that grows: an hour that both touch has the rows of both, once each."""
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = lambda hour, minute: f"2024-01-01 {hour:02d}:{minute:02d}:00"

    def add(name, rows):
        raw = spark.createDataFrame([(i, t, 1, "a", v, "") for i, (t, v) in enumerate(rows)], kind.replace("timestamp_ntz", "string"))
        raw.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        found = streaming.run_once(streaming.hourly(streaming.event_stream(spark, str(tmp_path / "in" / "*"), "*.parquet")), ["start"], str(tmp_path / "run"))
        return {r["start"].hour: (r["n"], r["mean_ws"]) for r in found.collect()}

    add("a", [(at(0, 5), 1.0), (at(0, 50), 3.0), (at(1, 10), 5.0)])
    assert run() == {0: (2, 2.0), 1: (1, 5.0)}
    add("b", [(at(1, 40), 7.0), (at(2, 0), 9.0)])
    assert run() == {0: (2, 2.0), 1: (2, 6.0), 2: (1, 9.0)} and run() == {0: (2, 2.0), 1: (2, 6.0), 2: (1, 9.0)}


def test_station_files(spark, tmp_path):
    (tmp_path / "produkt_a.txt").write_text("STATIONS_ID;MESS_DATUM;F\n 91;2024010203; 1.5\n 91;202401020310;-999\n")
    (tmp_path / "other.txt").write_text("nothing\n")
    rows = stations.read_semicolon(spark, str(tmp_path), ["F"], "produkt_*").orderBy("ts").collect()
    assert [(r["station_id"], r["ts"].minute, r["F"]) for r in rows] == [("00091", 0, 1.5), ("00091", 10, None)]


def test_fixed_width_and_registry(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes("id    name  \n----- ------\n00044 Mül   \n00071 Alb   \n".encode("latin-1"))
    rows = stations.read_fixed_width(spark, str(tmp_path / "w.txt"), [6, 6], ["id", "name"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("00044", "Mül"), ("00071", "Alb")]
    (tmp_path / "r.tsv").write_text("# all\nS\tkey\ttopic\text\n\nS1\taoi\tbase\tgpkg # the area\nS2\tdem\trelief\tdir\n")
    reg = stations.read_registry(spark, str(tmp_path / "r.tsv"))
    paths = stations.registry_paths(reg, "/d", F.col("S"), F.col("key"), F.col("ext")).orderBy("S")
    assert [r["path"] for r in paths.collect()] == ["/d/S1/aoi.gpkg", "/d/S2/dem"]


def test_parameter_names():
    assert stations.parameters(["RR", "FF", "XX"], ["R1", "F"]) == ["R1", "F"]
    with pytest.raises(ValueError, match="none of"):
        stations.parameters(["XX"], ["F"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    sinks.write_table(df, str(tmp_path / "t"))
    sinks.write_table(df, str(tmp_path / "t"), "ignore")
    sinks.write_tiles(df, str(tmp_path / "tiles"), "t")
    sinks.write_text(df, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert spark.read.parquet(str(tmp_path / "tiles")).filter("t = 'a'").count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_sinks_fill_to_the_lowest_pass(spark):
    import heapq

    z = {(r, c): float((r * 37 + c * 61) % 23) for r in range(8) for c in range(9)}
    level, heap = {}, []
    for (r, c), v in z.items():
        if r in (0, 7) or c in (0, 8):
            level[r, c] = v
            heapq.heappush(heap, (v, r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                n = (r + dr, c + dc)
                if n in z and n not in level:
                    level[n] = max(z[n], v)
                    heapq.heappush(heap, (level[n], *n))
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row long, col long, z double")
    assert {(r["row"], r["col"]): r["level"] for r in raster.fill_sinks(df, "z").collect()} == level


def test_evaluation_sample_is_a_fifth_of_all_ids(spark):
    for n, want in ((1500, 1500), (3000, 2000), (20000, 4000)):
        ids = [r["id"] for r in M.evaluation_sample(spark.range(n), "id").collect()]
        assert abs(len(ids) - want) <= 4 * (want * (1 - want / n)) ** 0.5 and len(set(ids)) == len(ids)
        assert abs(sum(ids) / len(ids) - n / 2) < 0.05 * n


def test_k_report_takes_the_silhouette_of_all_rows(spark):
    """The first 500 ids are one far group; the rest are two: a prefix of ids sees a single cluster, silhouette 0."""
    rows = [(i, (0.0 if i < 500 else 100.0 if i < 750 else 200.0) + i % 5) for i in range(1000)]
    got = M.k_report(spark.createDataFrame(rows, "id long, x double"), "id", ["x"], [3]).first()
    assert got["silhouette"] > 0.9

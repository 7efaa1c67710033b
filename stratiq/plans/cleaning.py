"""Scans, cleaning, reclassification, joins, sets and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions import circular
from stratiq.functions.numeric import cases, missing_to_null, r6
from stratiq.functions.spectral import mask_classes
from stratiq.operators import relational as R
from stratiq.operators.temporal import in_days
from stratiq.sources import stations

from .registry import query
from .views import table, twin, v_cell, v_feat, v_grid, v_seg, v_ts, whole


@query("SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS station_id, ts, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS ws, event_id FROM events WHERE event_type <> 'none'")
def station_scan_clean(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'none'")
    raw = F.when(F.col("event_id") % 97 == 0, F.lit(-999.0)).otherwise(F.col("value"))
    return e.select(stations.padded_id(F.col("user_id")).alias("station_id"), "ts", missing_to_null(raw).alias("ws"), "event_id")


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-16'")
def time_window_filter(spark, sf_dir):
    return in_days(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", "2024-01-10", "2024-01-15")


@query("SELECT o_orderkey, date_trunc('hour', o_orderdate) AS parsed FROM orders")
def parse_compact_ts(spark, sf_dir):
    # Even keys as yyyyMMddHH, odd ones as yyyyMMddHHmm.
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "yyyyMMddHH")
    long = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.concat(text, F.lit("00")))
    return o.select("o_orderkey", stations.compact_ts(long).alias("parsed"))


@query("SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS padded FROM supplier")
def zero_pad_id(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", stations.padded_id(F.col("s_suppkey")).alias("padded"))


@query("SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS num, upper(substr(s_name, 1, 4)) AS head FROM supplier")
def regex_extract_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.regexp_extract("s_name", "([0-9]+)", 1).cast("bigint").alias("num"), F.upper(F.substring("s_name", 1, 4)).alias("head"))


@query("SELECT n_name, CASE WHEN n_regionkey = 0 THEN concat_ws('/', '/data', r_name, n_name) ELSE concat_ws('/', '/data', r_name, n_name || '.gpkg') END AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    ext = F.when(F.col("n_regionkey") == 0, "dir").otherwise("gpkg")
    return stations.registry_paths(n, "/data", F.col("r_name"), F.col("n_name"), ext).select("n_name", "path")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(twin("SELECT station, ts, ws, wd FROM v_ts WHERE ws IS NOT NULL"))
def complete_cases(spark, sf_dir):
    return R.complete_cases(v_ts(spark, sf_dir), ["ws", "wd"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_discount <> 0")
def finite_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("_q", F.when(F.col("l_discount") != 0, F.col("l_quantity")).otherwise(F.lit(float("inf"))))
    return R.finite_rows(rows, ["_q", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'urban' WHEN p_size BETWEEN 5 AND 25 THEN 'cropland' WHEN p_size IN (30, 31) THEN 'grassland' WHEN p_size > 40 THEN 'forest' END AS class FROM part")
def case_reclass(spark, sf_dir):
    s = F.col("p_size")
    rules = [(s.between(1, 10), "urban"), (s.between(5, 25), "cropland"), (s.isin(30, 31), "grassland"), (s > 40, "forest")]
    return table(spark, sf_dir, "part").select("p_partkey", cases(s, rules).alias("class"))


@query("SELECT s_suppkey, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def lookup_reclass(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.lookup(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "code"), names.select(F.col("n_nationkey").alias("code"), "r_name"), "code", "r_name").select("s_suppkey", "r_name")


@query(twin("SELECT segment_id, round(avg(CASE WHEN cls IN ('A', 'R') THEN 1e0 ELSE 0e0 END), 6) AS fraction FROM v_cell GROUP BY segment_id"))
def class_fraction(spark, sf_dir):
    return v_cell(spark, sf_dir).groupBy("segment_id").agg(r6(F.avg(F.when(F.col("cls").isin("A", "R"), 1.0).otherwise(0.0))).alias("fraction"))


@query(twin("SELECT row, col, CASE WHEN cls IN ('1-URGENT', '2-HIGH') THEN NULL ELSE z END AS z FROM v_grid"))
def cloud_mask(spark, sf_dir):
    return v_grid(spark, sf_dir).select("row", "col", mask_classes("z", "cls", ("1-URGENT", "2-HIGH")).alias("z"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 4 AND 9 THEN 'Summer' ELSE 'Winter' END AS season FROM orders")
def season_flag(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", circular.season(F.month("o_orderdate")).alias("season"))


@query("SELECT c_custkey, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6e0) + 1 AS INTEGER) AS epsg FROM (SELECT c_custkey, c_custkey * 7 % 360 - 180 AS lon, c_custkey * 3 % 160 - 80 AS lat FROM customer)")
def utm_zone(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("lon", F.col("c_custkey") * 7 % 360 - 180).withColumn("lat", F.col("c_custkey") * 3 % 160 - 80)
    return c.select("c_custkey", circular.utm_epsg("lon", "lat").alias("epsg"))


@query(twin("SELECT s.segment_id, s.stratum, f.price FROM v_seg s LEFT JOIN (SELECT * FROM v_feat WHERE segment_id % 3 <> 0) f ON s.segment_id = f.segment_id"))
def join_left_attach(spark, sf_dir):
    f = v_feat(spark, sf_dir).filter("segment_id % 3 <> 0")
    return R.attach(v_seg(spark, sf_dir), f, "segment_id").select("segment_id", "stratum", "price")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.attach(table(spark, sf_dir, "orders"), c, "o_custkey", "inner").select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
def join_right(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return R.attach(o, table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query(twin("SELECT segment_id, area FROM v_seg WHERE segment_id IN (SELECT segment_id FROM v_cell WHERE w > 0.98e0)"))
def join_semi_candidates(spark, sf_dir):
    return R.attach(v_seg(spark, sf_dir), v_cell(spark, sf_dir).filter("w > 0.98").select("segment_id"), "segment_id", "left_semi").select("segment_id", "area")


@query(twin("SELECT segment_id, stratum FROM v_seg WHERE segment_id NOT IN (SELECT segment_id FROM v_seg WHERE segment_id % 5 = 2)"))
def fold_complement_anti(spark, sf_dir):
    s = v_seg(spark, sf_dir)
    return s.join(s.filter("segment_id % 5 = 2").select("segment_id"), "segment_id", "left_anti").select("segment_id", "stratum")


@query(twin(
    "SELECT s.segment_id, s.stratum, a.price, b.price AS price__dup, b.n FROM v_seg s LEFT JOIN (SELECT segment_id, avg(round(price * 100)) / 100 AS price FROM v_cell GROUP BY segment_id) a ON s.segment_id = a.segment_id "
    "LEFT JOIN (SELECT segment_id, max(price) AS price, count(*) AS n FROM v_cell WHERE cls = 'A' GROUP BY segment_id) b ON s.segment_id = b.segment_id"
))
def attrstack_join(spark, sf_dir):
    c = v_cell(spark, sf_dir)
    a = c.groupBy("segment_id").agg((F.avg(whole("price")) / 100).alias("price"))
    b = c.filter("cls = 'A'").groupBy("segment_id").agg(F.max("price").alias("price"), F.count(F.lit(1)).alias("n"))
    return R.attach_all(v_seg(spark, sf_dir), [a, b], "segment_id").select("segment_id", "stratum", "price", "price__dup", "n")


@query("SELECT a, b, c FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem), (SELECT DISTINCT o_orderpriority AS b FROM orders), (SELECT DISTINCT p_size AS c FROM part) WHERE NOT (a = 'A' AND b = '1-URGENT' AND c = 5)")
def param_grid(spark, sf_dir):
    """All combinations of the values that three tables hold, less the baseline."""
    one = lambda name, of, to: table(spark, sf_dir, name).select(F.col(of).alias(to)).distinct()
    return R.product_without([one("lineitem", "l_returnflag", "a"), one("orders", "o_orderpriority", "b"), one("part", "p_size", "c")], F.expr("a = 'A' AND b = '1-URGENT' AND c = 5"))


@query("SELECT n_name AS name, n_nationkey AS nation, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    return R.union_fill([n, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))]).select("name", "nation", "balance")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS r FROM customer) WHERE r <= 20")
def stratified_sample(spark, sf_dir):
    return R.stratified(table(spark, sf_dir, "customer"), "c_mktsegment", 20, (F.col("c_custkey") * 7919) % 10007, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 10007, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE r <= ceil(n * 0.1e0)")
def stratified_share(spark, sf_dir):
    return R.stratified_share(table(spark, sf_dir, "customer"), "c_mktsegment", 0.1, (F.col("c_custkey") * 7919) % 10007, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_first(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, try_cast(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS INTEGER) AS code FROM customer")
def cast_or_null(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.try_cast("int").alias("code"))


@query("SELECT n_name FROM nation WHERE regexp_matches(n_name, '[AEIOU0-9]$') AND n_regionkey IN (0, 1, 2)")
def regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "nation").filter(F.col("n_name").rlike("[AEIOU0-9]$") & F.col("n_regionkey").isin(0, 1, 2)).select("n_name")


@query(twin("SELECT s.*, t.cut FROM v_seg s, (SELECT quantile_cont(area, 0.75) AS cut FROM v_seg) t WHERE area >= cut"))
def quantile_threshold_filter(spark, sf_dir):
    s = v_seg(spark, sf_dir)
    return s.withColumn("cut", F.lit(R.quantiles(s, "area", [0.75])[0])).filter("area >= cut")


@query("SELECT c_custkey FROM customer ORDER BY (c_custkey * 7919) % 10007, c_custkey LIMIT 100")
def sample_rows(spark, sf_dir):
    return R.sample_rows(table(spark, sf_dir, "customer"), 100, (F.col("c_custkey") * 7919) % 10007, "c_custkey").select("c_custkey")


@query(twin("SELECT station, ts, last_value(ws IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ws FROM v_ts"))
def pad_last(spark, sf_dir):
    return R.pad_last(v_ts(spark, sf_dir).select("station", "ts", "ws"), ["station"], "ts", "ws")


@query("SELECT event_id AS id, value AS cloud, asset, '/scene/' || CAST(event_id AS VARCHAR) || '/' || asset AS href FROM events, (VALUES ('red'), ('nir')) a(asset) WHERE value < 5")
def scene_assets(spark, sf_dir):
    link = lambda name: F.concat(F.lit("/scene/"), F.col("event_id").cast("string"), F.lit(f"/{name}"))
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("datetime"), F.col("value").alias("cloud"), F.create_map(F.lit("red"), link("red"), F.lit("nir"), link("nir")).alias("assets"))
    return stations.scenes(items, 5.0).select("id", "cloud", "asset", "href")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 12:00:00'")
def time_window_closed(spark, sf_dir):
    """Both ends count, as radar composites are chosen."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").filter(F.col("ts").cast("timestamp_ntz").between(at("2024-01-05 00:00:00"), at("2024-01-09 12:00:00"))).select("event_id")


@query("SELECT n_nationkey, CASE WHEN count(*) OVER (PARTITION BY leaf) > 1 THEN r_name || '_' || leaf ELSE leaf END AS name FROM (SELECT n_nationkey, r_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'data' END AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey)")
def folder_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = n.select("n_nationkey", "r_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("data").alias("leaf"))
    return R.unique_leaves(leaves, "r_name", "leaf").select("n_nationkey", "name")


@query("SELECT c_custkey AS key, c_name AS label, c_nationkey AS unit FROM customer")
def rename_columns(spark, sf_dir):
    """A table of new names, and a prefix stripped by pattern; columns chosen by pattern; a contract on the result."""
    c = table(spark, sf_dir, "customer")
    out = R.rename_by(c.select(*R.columns_like(c, "key$|name$")), {"c_name": "c_label", "c_nationkey": "c_unit", "c_custkey": "c_key"}, "^c_")
    return R.contracted(out, ["key", "label", "unit"], ["key"])


@query("SELECT event_id, date_trunc('minute', ts) AS time FROM events WHERE date_trunc('minute', ts) >= TIMESTAMP '2024-01-05 00:00:00' AND date_trunc('minute', ts) <= TIMESTAMP '2024-01-09 12:00:00'")
def radar_index(spark, sf_dir):
    """Composites by the time in their file names, in a closed window."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    files = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("rw_10000-"), F.date_format("ts", "yyMMddHHmm"), F.lit("-dwd.bin.gz")).alias("path"))
    timed = files.select("event_id", stations.time_in_name(F.col("path"), r"-(\d{10})-").alias("time"))
    return timed.filter(F.col("time").between(at("2024-01-05 00:00:00"), at("2024-01-09 12:00:00")))

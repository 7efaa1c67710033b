"""The fixture tables seen as segments, cells, grids, series and points: once as DataFrames, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions with the same columns as the functions below.
SQL = {
    "v_seg": "SELECT p_partkey AS segment_id, p_type AS stratum, p_brand AS cov, p_retailprice AS area, p_size AS size, (p_partkey % 50) * 100 AS x, CAST(floor(p_partkey / 50e0) AS BIGINT) * 100 AS y FROM part",
    "v_cell": "SELECT l_partkey AS segment_id, l_quantity / 50e0 AS w, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS cls, l_linestatus AS cls2, l_linenumber AS ord FROM lineitem",
    "v_grid": "SELECT CAST(floor(o_orderkey / 100e0) AS BIGINT) AS row, o_orderkey % 100 AS col, o_totalprice AS z, o_orderpriority AS cls, o_orderstatus AS lab FROM orders",
    "v_ts": "SELECT user_id AS station, ts, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS ws, CAST((event_id * 37) % 360 AS DOUBLE) AS wd FROM events",
    "v_pt": "SELECT c_custkey AS id, (c_custkey * 7919) % 10000 AS x, (c_custkey * 104729) % 10000 AS y, c_mktsegment AS grp FROM customer",
    "v_rect": "SELECT n_nationkey AS rect_id, (n_nationkey % 5) * 2000 AS x0, CAST(floor(n_nationkey / 5e0) AS INTEGER) * 2000 AS y0, (n_nationkey % 5) * 2000 + 2000 AS x1, CAST(floor(n_nationkey / 5e0) AS INTEGER) * 2000 + 2000 AS y1 FROM nation",
    "v_feat": "SELECT segment_id, avg(round(price * 100)) / 100 AS price, avg(round(disc * 100)) / 100 AS disc, avg(round(tax * 100)) / 100 AS tax, avg(round(w * 50)) / 50 AS w, avg(CAST(ord AS DOUBLE)) AS ord FROM v_cell GROUP BY segment_id",
    "v_dist": "SELECT f.segment_id, " + ", ".join(f"round(abs((f.{c} - g.m_{c}) / g.s_{c}), 9) AS d_{c}" for c in ("price", "disc", "tax", "w", "ord")) + " FROM v_feat f, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("price", "disc", "tax", "w", "ord")) + " FROM v_feat) g",
    "v_site": "SELECT s.*, " + ", ".join(f"d.d_{c}" for c in ("price", "disc", "tax", "w", "ord")) + " FROM v_seg s LEFT JOIN v_dist d ON s.segment_id = d.segment_id",
    "v_vec": "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(8)) + " FROM embeddings",
    # Whole vectors; one that is shorter than others or holds a null has no place.
    "v_whole": "SELECT vec_id, CASE WHEN list_count(embedding) = max(len(embedding)) OVER () THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings",
}
DOMAINS = ("price", "disc", "tax", "w", "ord")
VEC = [f"e{i}" for i in range(8)]


def twin(select: str, recursive: bool = False, **ctes: str) -> str:
    """A statement over the views: only those that it needs, in order, then its own expressions."""
    text, used = select + " ".join(ctes.values()), []
    for name in reversed(SQL):
        if name in text:
            used.insert(0, name)
            text += SQL[name]
    parts = [f"{n} AS ({SQL[n]})" for n in used] + [f"{n} AS ({body})" for n, body in ctes.items()]
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + select


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("segment_id"), F.col("p_type").alias("stratum"), F.col("p_brand").alias("cov"), F.col("p_retailprice").alias("area"), F.col("p_size").alias("size"), ((k % 50) * 100).alias("x"), (F.floor(k / 50) * 100).alias("y")
    )


def v_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("segment_id"), (F.col("l_quantity") / 50).alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("cls"), F.col("l_linestatus").alias("cls2"), F.col("l_linenumber").alias("ord"),
    )


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / 100).alias("row"), (k % 100).alias("col"), F.col("o_totalprice").alias("z"), F.col("o_orderpriority").alias("cls"), F.col("o_orderstatus").alias("lab"))


def v_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-999 stands for missing values in the raw series; here it is null."""
    from stratiq.functions.numeric import missing_to_null

    raw = F.when(F.col("event_id") % 97 == 0, F.lit(-999.0)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", missing_to_null(raw).alias("ws"), ((F.col("event_id") * 37) % 360).cast("double").alias("wd"))


def v_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 10000).alias("x"), ((k * 104729) % 10000).alias("y"), F.col("c_mktsegment").alias("grp"))


def v_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k % 5) * 2000, (F.floor(k / 5) * 2000).cast("int")
    return table(spark, sf_dir, "nation").select(k.alias("rect_id"), x.alias("x0"), y.alias("y0"), (x + 2000).alias("x1"), (y + 2000).alias("y1"))


#: Steps of the columns that are whole numbers of something: cents, hundredths, fiftieths.
STEPS = {"price": 100, "disc": 100, "tax": 100, "w": 50, "ord": 1}


def whole(column: str, steps: int = 100) -> Column:
    """The column as a whole number of its steps: sums of such numbers are exact, in whatever order they are added."""
    return F.round(F.col(column).cast("double") * steps)


def v_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means from exact sums."""
    return v_cell(spark, sf_dir).groupBy("segment_id").agg(*[(F.avg(whole(c, n)) / n).alias(c) for c, n in STEPS.items()])


def v_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratiq.operators.relational import zscores

    z = zscores(v_feat(spark, sf_dir), DOMAINS)
    return z.select("segment_id", *[F.round(F.abs(F.col(f"{c}_z")), 9).alias(f"d_{c}") for c in DOMAINS])


def v_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_seg(spark, sf_dir).join(v_dist(spark, sf_dir), "segment_id", "left")


def v_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])


def v_whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Vectors with all their components, and the components' names."""
    rows = table(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0))]
    return rows.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(e) for i, e in enumerate(names)]), names

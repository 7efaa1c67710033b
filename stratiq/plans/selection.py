"""Decisions: score fusion, filters, quotas, scenarios and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratiq.functions.numeric import r6
from stratiq.operators import decision as D, relational as R

from .registry import query
from .views import DOMAINS, twin, v_seg, v_site

WEIGHTS = {"d_price": 0.3, "d_disc": 0.25, "d_tax": 0.2, "d_w": 0.15, "d_ord": 0.1}
_SCORE = " + ".join(f"(d_{c} - (SELECT min(d_{c}) FROM f)) / nullif((SELECT max(d_{c}) - min(d_{c}) FROM f), 0) * {WEIGHTS[f'd_{c}']}e0" for c in DOMAINS)
_FUSED = f"SELECT *, {_SCORE} AS mcda_score FROM f"
CONDITION = "size >= 10 AND cov <> 'Brand#11'"


def _picked(per: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round(mcda_score, 9), segment_id) AS r FROM m WHERE mcda_score IS NOT NULL) WHERE r <= {per}"


@query(twin("SELECT segment_id, round(mcda_score, 6) AS mcda_score FROM m WHERE mcda_score IS NOT NULL ORDER BY m.mcda_score, segment_id LIMIT 50", f="SELECT * FROM v_site", m=_FUSED))
def mcda_fusion_topn(spark, sf_dir):
    return D.lowest(D.mcda(v_site(spark, sf_dir), WEIGHTS), "mcda_score", "segment_id", 50).select("segment_id", r6("mcda_score").alias("mcda_score"))


@query(twin(f"SELECT segment_id, cov, size FROM v_seg WHERE {CONDITION}"))
def filter_expr_scenario(spark, sf_dir):
    return R.filter_text(v_seg(spark, sf_dir), CONDITION).select("segment_id", "cov", "size")


@query(twin(f"SELECT segment_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY d_price, d_disc, segment_id) AS r FROM v_site WHERE {CONDITION} AND d_price IS NOT NULL AND d_disc IS NOT NULL) WHERE r <= 4"))
def selector_lex(spark, sf_dir):
    return D.select_sites(v_site(spark, sf_dir), D.Setting("lex", "stratum", 4, CONDITION, rank=("d_price", "d_disc")), "segment_id").select("segment_id", "stratum")


def _fused(scope: str) -> D.Setting:
    return D.Setting(scope, "stratum", 5, CONDITION, weights=WEIGHTS, scope=scope)


@query(twin("SELECT segment_id, stratum, round(mcda_score, 6) AS mcda_score FROM p", f=f"SELECT * FROM v_site WHERE {CONDITION}", m=_FUSED, p=_picked(5)))
def selector_mcda_filtered(spark, sf_dir):
    return D.select_sites(v_site(spark, sf_dir), _fused("filtered"), "segment_id").select("segment_id", "stratum", r6("mcda_score").alias("mcda_score"))


@query(twin("SELECT segment_id, stratum, round(mcda_score, 6) AS mcda_score FROM p", f="SELECT * FROM v_site", m=f"SELECT * FROM ({_FUSED}) WHERE {CONDITION}", p=_picked(5)))
def selector_mcda_global(spark, sf_dir):
    return D.select_sites(v_site(spark, sf_dir), _fused("global"), "segment_id").select("segment_id", "stratum", r6("mcda_score").alias("mcda_score"))


SPACED = D.Setting("spaced", "stratum", 40, CONDITION, rank=("d_price",), spacing=300.0)


@query()
def selector_spacing(spark, sf_dir):
    """Quotas of 40 per stratum, thinned to a spacing of 300; a test checks the spacing and the greedy order."""
    return D.select_sites(v_site(spark, sf_dir), SPACED, "segment_id").select("segment_id", "stratum", "x", "y")


@query(twin(
    "SELECT setting, segment_id, stratum FROM (SELECT 'A' AS setting, segment_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY d_price, segment_id) AS r, 3 AS n FROM v_site WHERE d_price IS NOT NULL UNION ALL "
    "SELECT 'B', segment_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY d_w, d_tax, segment_id), 2 FROM v_site WHERE d_w IS NOT NULL AND d_tax IS NOT NULL AND size < 25) WHERE r <= n"
))
def scenario_union(spark, sf_dir):
    settings = [D.Setting("A", "stratum", 3, rank=("d_price",)), D.Setting("B", "stratum", 2, "size < 25", rank=("d_w", "d_tax"))]
    return D.scenarios(v_site(spark, sf_dir), settings, "segment_id", ["segment_id", "stratum"])


@query(twin("SELECT s.stratum, s.units, coalesce(p.picked, 0) AS picked, round(coalesce(p.picked, 0) / CAST(s.units AS DOUBLE), 6) AS share FROM (SELECT stratum, count(*) AS units FROM v_seg GROUP BY stratum) s LEFT JOIN (SELECT stratum, count(*) AS picked FROM v_site WHERE d_price < 0.1e0 GROUP BY stratum) p ON s.stratum = p.stratum"))
def validation_coverage(spark, sf_dir):
    return D.coverage(v_seg(spark, sf_dir), v_site(spark, sf_dir).filter("d_price < 0.1"), "stratum").select("stratum", "units", F.col("picked").cast("bigint").alias("picked"), r6("share").alias("share"))


@query(twin('SELECT count(*) FILTER (WHERE d_price < 0.1e0) AS "first", count(*) FILTER (WHERE d_w < 0.1e0) AS "second", count(*) FILTER (WHERE d_price < 0.1e0 AND d_w < 0.1e0) AS "both" FROM v_site'))
def validation_overlap(spark, sf_dir):
    s = v_site(spark, sf_dir)
    return D.overlap(s.filter("d_price < 0.1").select("segment_id"), s.filter("d_w < 0.1").select("segment_id"), "segment_id")


@query(twin(
    "SELECT stratum, units, coalesce(picked, 0) AS picked, round((pw - mw) / nullif(sw, 0), 6) AS w_gap, round((pt - mt) / nullif(st, 0), 6) AS tax_gap FROM "
    "(SELECT stratum, count(*) AS units, avg(d_w) AS mw, stddev_samp(d_w) AS sw, avg(d_tax) AS mt, stddev_samp(d_tax) AS st FROM v_site GROUP BY stratum) "
    "LEFT JOIN (SELECT stratum, count(*) AS picked, avg(d_w) AS pw, avg(d_tax) AS pt FROM v_site WHERE d_price < 0.1e0 GROUP BY stratum) USING (stratum)"))  # fmt: skip
def validation_domains(spark, sf_dir):
    """How far the picked units of each stratum are from its average."""
    s = v_site(spark, sf_dir)
    out = D.domain_summary(s, s.filter("d_price < 0.1"), "stratum", ["d_w", "d_tax"])
    return out.select("stratum", "units", "picked", r6("d_w_gap").alias("w_gap"), r6("d_tax_gap").alias("tax_gap"))

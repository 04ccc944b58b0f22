"""Queries for episode weights and proportional sampling (SW)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.catalog.fixtures import cut, factors, r6, report, with_views
from barloom.operators import weights

BETA, DRAWS = 2.0, 64


def simple(spark, sf):
    r = F.col("r")
    return report(factors(spark, sf).select(
        "vec_id", weights.exponential_weight(r, BETA).alias("exp_weight"),
        weights.sigmoid_weight(r, BETA).alias("sigmoid_weight")))


SQL_SIMPLE = with_views(["fx_factors"]) + f"""
SELECT vec_id, {cut(f'exp({BETA}*r)', 'exp_weight')}, {cut(f'1/(1+exp(-{BETA}*r))', 'sigmoid_weight')} FROM fx_factors"""

DENSITY = {
    "hb": """select 1.06*least(stddev_pop(r), (quantile_cont(r,0.75)-quantile_cont(r,0.25))/1.34)*pow(count(*), -0.2::double) h,
        min(r) lo, count(*) c, quantile_cont(r,0.05) a, quantile_cont(r,0.95) b from fx_factors""",
    "dn": f"""select x.vec_id, any_value(x.r) r, sum(exp(-(x.r-y.r)*(x.r-y.r)/(2*h*h)))/(any_value(c)*any_value(h)*sqrt(2*{math.pi!r}::double)) density
        from fx_factors x, fx_factors y, hb group by x.vec_id""",
    "sm": "select sum(1/density) inv, sum(density) whole from dn",
    "rw": "select vec_id, r, density, inv, whole, a, b from dn, hb, sm",
}


def even(spark, sf):
    rows = factors(spark, sf).select("vec_id", "r")
    made = weights.density_weights(rows, "r", out="weight")
    return report(made.select("vec_id", (F.col("weight") * 1000).alias("weight")))


SQL_EVEN = with_views(["fx_factors"], **DENSITY) + f"\nSELECT vec_id, {cut('1000/density/inv', 'weight')} FROM rw"


def even_exp(spark, sf):
    rows = factors(spark, sf).select("vec_id", "r")
    made = weights.density_weights(rows, "r", shape="exp", beta=BETA)
    return report(made.select("vec_id", (F.col("weight") * 1000).alias("weight")))


SQL_EVEN_EXP = with_views(["fx_factors"], **DENSITY) + f"\nSELECT vec_id, {cut(f'1000/density/inv*exp({BETA}*r)', 'weight')} FROM rw"


def tails(spark, sf):
    rows = factors(spark, sf).select("vec_id", "r")
    return report(weights.density_weights(rows, "r", tail=0.1, shape="sigmoid", beta=BETA), "vec_id", "weight")


SQL_TAILS = with_views(
    ["fx_factors"], **DENSITY,
    t=f"select vec_id, (case when r between a and b then whole/density else 1 end)/(1+exp(-{BETA}*r)) weight from rw",
) + f"\nSELECT vec_id, {r6('weight')} FROM t"


def sampled(spark, sf):
    rows = factors(spark, sf).select("vec_id", (F.abs("r") + 0.01).alias("priority"))
    return report(weights.stratified_sample(rows, "vec_id", "priority", DRAWS, 0.4), "draw", "vec_id", "priority", "importance")


SQL_SAMPLED = with_views(
    ["fx_factors"],
    p="select vec_id, abs(r)+0.01::double priority from fx_factors",
    c="""select *, sum(priority) over (order by vec_id) upto, sum(priority) over () total, count(*) over () n from p""",
    d=f"""select i draw, (i+('0x'||substr(md5(concat_ws('|', i, '0')),1,8))::bigint/4294967296.0::double)*t.total/{DRAWS} point
        from (select unnest(range({DRAWS})) i), (select sum(priority) total from p) t""",
    h="""select draw, vec_id, priority, pow(n*priority/total, -0.4::double) raw from d join c
        on point >= upto-priority and point < upto""",
) + f"\nSELECT draw, vec_id, {r6('priority')}, {cut('raw/(select max(raw) from h)', 'importance')} FROM h"

QUERIES = {
    "return_weights": (simple, SQL_SIMPLE),
    "even_weights": (even, SQL_EVEN),
    "even_exponential_weights": (even_exp, SQL_EVEN_EXP),
    "tail_weights": (tails, SQL_TAILS),
    "stratified_sample": (sampled, SQL_SAMPLED),
}

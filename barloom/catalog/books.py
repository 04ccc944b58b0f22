"""Queries over order-book snapshots (PR2, RS1, CS7-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, book, r6, report, with_views
from barloom.operators import resample
from barloom.operators.book import snapshot_features
from barloom.sources.tables import book_columns

K = 5


def snapshots(spark, sf):
    return report(snapshot_features(book(spark, sf), ["symbol", "book_id"], K))


def _snapshot_sql() -> str:
    a, b = "ask_size", "bid_size"
    cols = {
        "midprice": "(ask_price[1]+bid_price[1])/2",
        "wap_1": f"({a}[1]*bid_price[1]+{b}[1]*ask_price[1])/({a}[1]+{b}[1])",
        "wap_2": f"({a}[2]*bid_price[2]+{b}[2]*ask_price[2])/({a}[2]+{b}[2])",
        "sell_wap": f"list_dot_product({a}, ask_price)/list_sum({a})",
        "buy_wap": f"list_dot_product({b}, bid_price)/list_sum({b})",
        "buy_spread_oe_max": "abs(bid_price[1]-bid_price[25])",
        "sell_spread_oe_max": "abs(ask_price[1]-ask_price[25])",
        "buy_volume_oe": f"list_sum({b})", "sell_volume_oe": f"list_sum({a})",
        "imblance_volume_oe": f"(list_sum({b})-list_sum({a}))/(list_sum({b})+list_sum({a})+1e-15)",
    }
    cols["wap_balance"] = f"{cols['wap_1']}-{cols['wap_2']}"
    cols["buy_sell_wap_spread"] = f"{cols['buy_wap']}-{cols['sell_wap']}"
    for side in ("ask", "bid"):
        for i in range(1, K + 1):
            cols[f"{side}_price_topk_size_{i}_increments"] = f"{side}_top[{20 + i}].p-{side}_price[1]"
            cols[f"{side}_size_topk_size_{i}_increments"] = f"{side}_top[{20 + i}].s-{side}_size[1]"
        for i in range(1, 26):
            cols[f"{side}{i}_size_n"] = f"{side}_size[{i}]/list_sum({side}_size)"
    tops = ", ".join(
        f"list_sort([{{'s': {s}_size[i], 'l': i, 'p': {s}_price[i]}} for i in range(1, 26)]) {s}_top"
        for s in ("ask", "bid"))
    return with_views(
        ["fx_book"], t=f"select *, {tops} from fx_book",
        f="select symbol, book_id, " + ", ".join(f"{v} {n}" for n, v in cols.items()) + " from t",
    ) + f"\nSELECT symbol, book_id, {r6(*cols)} FROM f"


def downscaled(spark, sf):
    """Two-level book downscale: hourly firsts of 10-minute firsts, flattened."""
    arrays = ["ask_price", "ask_size", "bid_price", "bid_size"]
    fine = resample.downscale(book(spark, sf), 600, arrays, order=["ts", "book_id"])
    return report(book_columns(resample.downscale(fine, HOUR, arrays, ts="bucket")))


SQL_DOWNSCALED = with_views(
    ["fx_book"], h="""select symbol, date_trunc('hour', ts) bucket, arg_min(ask_price, ts) ap, arg_min(ask_size, ts) a,
        arg_min(bid_price, ts) bp, arg_min(bid_size, ts) b from fx_book group by 1, 2""",
    f="select symbol, bucket, " + ", ".join(
        f"ap[{i}] ask{i}_price, a[{i}] ask{i}_size, bp[{i}] bid{i}_price, b[{i}] bid{i}_size" for i in range(1, 26)
    ) + " from h",
) + "\nSELECT symbol, epoch_us(bucket) bucket, " + r6(*[
    f"{s}{i}_{f}" for i in range(1, 26) for s in ("ask", "bid") for f in ("price", "size")
]) + " FROM f"


def depth_distribution(spark, sf):
    """Book imbalance summarised over all snapshots."""
    made = snapshot_features(book(spark, sf), ["symbol", "book_id"], K)
    return report(resample.describe(made, ["imblance_volume_oe", "wap_1"])).select(
        "feature", "count", "mean", "q25", "q50", "q75", F.col("std"))


SQL_DEPTH = with_views(
    ["fx_book"],
    u="""select 'imblance_volume_oe' feature, (list_sum(bid_size)-list_sum(ask_size))/
        (list_sum(bid_size)+list_sum(ask_size)+1e-15) v from fx_book union all
        select 'wap_1', (ask_size[1]*bid_price[1]+bid_size[1]*ask_price[1])/(ask_size[1]+bid_size[1]) from fx_book""",
    d="""select feature, count(*) "count", avg(v) mean, stddev_samp(v) std, quantile_cont(v,0.25) q25,
        quantile_cont(v,0.5) q50, quantile_cont(v,0.75) q75 from u group by feature""",
) + f'\nSELECT feature, "count", {r6("mean", "std", "q25", "q50", "q75")} FROM d'

QUERIES = {
    "book_features": (snapshots, _snapshot_sql()),
    "book_downscale": (downscaled, SQL_DOWNSCALED),
    "book_distribution": (depth_distribution, SQL_DEPTH),
}

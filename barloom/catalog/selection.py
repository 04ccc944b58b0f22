"""Queries for factor selection and scaling (FS), and for samples of factors (SL6-SL10, PR8, SE3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import FEATURES, cut, factors, hourly_bars, r6, report, with_views
from barloom.catalog.fixtures import HOUR
from barloom.operators import boosting, gram, resample, sampling, selection
from barloom.operators.ordering import Ordered
from barloom.session import settle

H = (1, 6, 12)
IC_MIN, CORR_MAX = 0.03, 0.15


def _targets(spark, sf):
    series = Ordered.on_steps(factors(spark, sf), [], "vec_id")
    return selection.forward_targets(series, "mark_price", H)


TARGET_VIEWS = {
    "t": "select *, " + ", ".join(
        f"lead(mark_price,{h}) over (order by vec_id)-mark_price target_{h}" for h in H) + " from fx_factors",
}
IC_VIEWS = TARGET_VIEWS | {
    "w": "select " + ", ".join(f"corr({f}, target_{h}) {f}_{h}" for f in FEATURES for h in H) + " from t",
    "ics": " union all ".join(f"select '{f}' feature, {h} horizon, {f}_{h} ic from w" for f in FEATURES for h in H),
}
PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]
CORR_VIEWS = {
    "cw": "select " + ", ".join(f"corr({a},{b}) {a}_{b}" for a, b in PAIRS) + " from fx_factors",
    "corrs": " union all ".join(f"select '{a}' f1, '{b}' f2, {a}_{b} c from cw" for a, b in PAIRS),
}


def targets(spark, sf):
    return report(_targets(spark, sf), "vec_id", *[f"target_{h}" for h in H])


SQL_TARGETS = with_views(["fx_factors"], **TARGET_VIEWS) + f"\nSELECT vec_id, {r6(*[f'target_{h}' for h in H])} FROM t"


def coefficients(spark, sf):
    return report(selection.information_coefficients(_targets(spark, sf), FEATURES, H))


SQL_COEFFICIENTS = with_views(["fx_factors"], **IC_VIEWS) + f"\nSELECT feature, horizon, {r6('ic')} FROM ics"


def rank_coefficients(spark, sf):
    return report(selection.rank_coefficients(settle(_targets(spark, sf), "targets"), FEATURES, H))


SQL_RANK = with_views(
    ["fx_factors"], **TARGET_VIEWS,
    u=" union all ".join(f"select '{f}' feature, {h} horizon, {f} x, target_{h} y from t where target_{h} is not null"
                         for f in FEATURES for h in H),
    k="""select feature, horizon,
        rank() over (partition by feature, horizon order by x)+(count(*) over (partition by feature, horizon, x)-1)/2 rx,
        rank() over (partition by feature, horizon order by y)+(count(*) over (partition by feature, horizon, y)-1)/2 ry from u""",
    i="select feature, horizon, corr(rx, ry) ic from k group by feature, horizon",
) + f"\nSELECT feature, horizon, {r6('ic')} FROM i"


def rank_labels(spark, sf):
    """Rank coefficients of each label by itself."""
    rows = settle(_targets(spark, sf).withColumn("label", F.col("label").cast("long")), "targets")
    return report(selection.rank_coefficients(rows, FEATURES, H, keys=["label"]))


SQL_RANK_LABELS = with_views(
    ["fx_factors"], **TARGET_VIEWS,
    u=" union all ".join(f"select label::bigint AS label, '{f}' feature, {h} horizon, {f} x, target_{h} y from t where target_{h} is not null"
                         for f in FEATURES for h in H),
    k="""select label, feature, horizon,
        rank() over (partition by label, feature, horizon order by x)+(count(*) over (partition by label, feature, horizon, x)-1)/2 rx,
        rank() over (partition by label, feature, horizon order by y)+(count(*) over (partition by label, feature, horizon, y)-1)/2 ry from u""",
    i="select label, feature, horizon, corr(rx, ry) ic from k group by all",
) + f"\nSELECT label, feature, horizon, {r6('ic')} FROM i"


def label_features(spark, sf):
    """Features chosen and pruned for each label by itself."""
    rows = settle(_targets(spark, sf).withColumn("label", F.col("label").cast("long")), "targets")
    scores = settle(selection.information_coefficients(rows, FEATURES, H, ["label"]), "scores")
    return selection.select_features_by_key(rows, scores, 0.1, CORR_MAX, ["label"])


SQL_LABEL_FEATURES = with_views(
    ["fx_factors"], **TARGET_VIEWS,
    i=" union all ".join(f"select label::bigint AS label, '{f}' feature, {h} horizon, corr({f}, target_{h}) ic from t group by label"
                         for f in FEATURES for h in H),
    o="""select label, feature, horizon, -abs(ic) down from i where abs(ic) > 0.1
        qualify row_number() over (partition by label, feature order by horizon) = 1""",
    lists="select label, list(feature order by horizon, down, feature) names from o group by label",
    cl=" union all ".join(f"select label::bigint AS label, '{a}' f1, '{b}' f2, corr({a}, {b}) c from fx_factors group by label" for a, b in PAIRS),
    near=f"""select label, list(f1||'~'||f2) l from (select label, f1, f2 from cl where abs(c) > {CORR_MAX}
        union all select label, f2, f1 from cl where abs(c) > {CORR_MAX}) group by label""",
    kept="""select label, list_reduce(list_prepend([]::varchar[], list_transform(names, lambda n: [n])), lambda acc, n:
        case when len(list_filter(acc, lambda a: list_contains(coalesce(l, []::varchar[]), a||'~'||n[1]))) > 0 then acc
             else list_concat(acc, n) end) k from lists left join near using (label)""",
) + """
SELECT label, unnest(k) feature, generate_subscripts(k, 1) AS rank FROM kept"""


def thresholds(spark, sf):
    scores = selection.information_coefficients(_targets(spark, sf), FEATURES, H)
    return report(selection.select_by_threshold(scores, IC_MIN))


PASS_VIEWS = IC_VIEWS | {
    "p": f"select * from ics where abs(ic) > {IC_MIN}",
    "o": "select feature, horizon, abs(ic) score, row_number() over (partition by feature order by horizon) k from p",
}
SQL_THRESHOLDS = with_views(["fx_factors"], **PASS_VIEWS) + f"\nSELECT feature, horizon, {r6('score')} FROM o WHERE k = 1"


def label_matrix(spark, sf):
    """Correlations of each label by itself, from the same scan."""
    rows = factors(spark, sf).withColumn("label", F.col("label").cast("long"))
    return report(selection.correlations(rows, FEATURES, keys=["label"]))


SQL_LABEL_MATRIX = with_views(["fx_factors"], c=" union all ".join(
    f"select label::bigint AS label, '{a}' f1, '{b}' f2, corr({a}, {b}) c from fx_factors group by label" for a, b in PAIRS)) + f"""
SELECT label, f1, f2, {cut('c', 'corr')} FROM c"""


def matrix(spark, sf):
    return report(selection.correlations(factors(spark, sf), FEATURES))


SQL_MATRIX = with_views(["fx_factors"], **CORR_VIEWS) + f"\nSELECT f1, f2, {cut('c', 'corr')} FROM corrs"


def pruned(spark, sf):
    scores = selection.information_coefficients(_targets(spark, sf), FEATURES, H)
    made = selection.select_features(factors(spark, sf), scores, IC_MIN, CORR_MAX)
    return made.withColumn("rank", F.col("rank").cast("long"))


# The greedy walk as a fold over the ordered names: a name joins when no kept
# name is close to it.
SQL_PRUNED = with_views(
    ["fx_factors"], **PASS_VIEWS, **CORR_VIEWS,
    near=f"""select list(f1||'~'||f2) l from (select f1, f2 from corrs where abs(c) > {CORR_MAX}
        union all select f2, f1 from corrs where abs(c) > {CORR_MAX})""",
    nms="select list([feature] order by horizon, score desc) l from o where k = 1",
    kept="""select list_reduce(nms.l, lambda acc, x: case when list_has_any(
        list_transform(acc, lambda a: a||'~'||x[1]), near.l) then acc else list_concat(acc, x) end) l from nms, near""",
) + """
SELECT i "rank", l[i] feature FROM (SELECT l, unnest(range(1, len(l)+1)) i FROM kept)"""


def repruned(spark, sf):
    """Selection from stored score tables with other thresholds."""
    stored = settle(selection.information_coefficients(_targets(spark, sf), FEATURES, H), "scores")
    made = selection.select_features(factors(spark, sf), stored, IC_MIN * 1.5, CORR_MAX / 2)
    return made.withColumn("rank", F.col("rank").cast("long"))


SQL_REPRUNED = SQL_PRUNED.replace(f"> {IC_MIN}", f"> {IC_MIN * 1.5}").replace(f"> {CORR_MAX}", f"> {CORR_MAX / 2}")


def scaled(spark, sf):
    return report(selection.power_of_ten_scale(
        factors(spark, sf).withColumn("f3", F.col("f3") * 1000 + 123456), FEATURES), "vec_id", *FEATURES)


def label_scaled(spark, sf):
    """The same with the scales of each label."""
    rows = factors(spark, sf).withColumns({"f3": F.col("f3") * 1000 + 123456 * F.col("label"), "label": F.col("label").cast("long")})
    return report(selection.power_of_ten_scale(rows, FEATURES, keys=["label"]), "vec_id", "label", *FEATURES)


def _label_scaled_sql() -> str:
    src = "select vec_id, label::bigint AS label, " + ", ".join(f"{f}*1000+123456*label {f}" if f == "f3" else f for f in FEATURES) + " from fx_factors"
    st = "select label, " + ", ".join(
        f"pow(10, floor(log10(stddev_samp({f})))) p_{f}, avg({f})/pow(10, floor(log10(stddev_samp({f})))) m_{f}" for f in FEATURES) + " from x group by label"
    out = ", ".join(
        f"{f}/p_{f}-(case when abs(m_{f})>10 then sign(m_{f})*pow(10, round_even(log10(abs(m_{f})),0)) else 0 end) {f}" for f in FEATURES)
    return with_views(["fx_factors"], x=src, st=st, y=f"select vec_id, label, {out} from x join st using (label)") + \
        f"\nSELECT vec_id, label, {r6(*FEATURES)} FROM y"


def _scaled_sql() -> str:
    src = "select vec_id, " + ", ".join(f"{f}*1000+123456 {f}" if f == "f3" else f for f in FEATURES) + " from fx_factors"
    st = "select " + ", ".join(
        f"pow(10, floor(log10(stddev_samp({f})))) p_{f}, avg({f})/pow(10, floor(log10(stddev_samp({f})))) m_{f}" for f in FEATURES) + " from x"
    out = ", ".join(
        f"{f}/p_{f}-(case when abs(m_{f})>10 then sign(m_{f})*pow(10, round_even(log10(abs(m_{f})),0)) else 0 end) {f}" for f in FEATURES)
    return with_views(["fx_factors"], x=src, st=st, y=f"select vec_id, {out} from x, st") + \
        f"\nSELECT vec_id, {r6(*FEATURES)} FROM y"


TREES, DEPTH, RATE = 3, 2, 0.1


def trees(spark, sf):
    """Importance of each factor for each label and horizon, all in one run."""
    made_of = settle(_targets(spark, sf).withColumn("label", F.col("label").cast("long")), "targets")
    return report(selection.tree_importance(made_of, FEATURES, H, DEPTH, TREES, RATE, ["label"]))


def boosted(spark, sf):
    """Prediction of each row by trees over all rows."""
    made_of = settle(_targets(spark, sf), "targets")
    return report(selection.boosted_prediction(made_of, FEATURES, "target_1", DEPTH, TREES, RATE, ["vec_id"]))


def tree_errors(spark, sf):
    """Mean absolute error of the trees and of the median alone, for each label and horizon."""
    made_of = settle(_targets(spark, sf).withColumn("label", F.col("label").cast("long")), "targets")
    made = boosting.boosted(made_of, FEATURES, {h: f"target_{h}" for h in H}, ["label"], trees=TREES, depth=DEPTH, rate=RATE)
    return report(made.errors())


def _tree_views(key: str, horizons) -> dict:
    """The same trees level by level in SQL: bins, signs by (node, feature, bin), best split, medians of leaves."""
    by = "k, h"
    views = TARGET_VIEWS | {
        "ft": f"select {key}::bigint k, vec_id, unnest([{', '.join(FEATURES)}]) v, unnest(range(8)) pos from t",
        "q": f"select k, pos, quantile_cont(v, [{', '.join(f'{i}/16' for i in range(1, 16))}]) q from ft group by all",
        "bn": "select vec_id, list(len(list_filter(q, lambda c: c < v)) order by pos) b from ft join q using (k, pos) group by vec_id",
        "r0": " union all ".join(f"select {key}::bigint k, vec_id, {h} h, target_{h} y from t where target_{h} is not null" for h in horizons),
        "s0": f"select {by}, median(y) start from r0 group by all",
        "p0": "select r0.*, start, start pred, b from r0 join s0 using (k, h) join bn using (vec_id)",
    }
    gains = []
    for t in range(TREES):
        views[f"n{t}_0"] = f"select *, 1 node from p{t}"
        for d in range(DEPTH):
            n, s = f"n{t}_{d}", f"s{t}_{d}"
            views[f"h{t}_{d}"] = f"""select {by}, node, pos, bin, sum(g) g, count(*) n from (select {by}, node, sign(y-pred)::bigint g,
                unnest(b) bin, unnest(range(8)) pos from {n}) group by all"""
            views[f"c{t}_{d}"] = f"""select *, sum(g) over o gl, sum(n) over o nl, sum(g) over a ga, sum(n) over a na from h{t}_{d}
                window o as (partition by {by}, node, pos order by bin), a as (partition by {by}, node, pos)"""
            views[f"g{t}_{d}"] = f"""select {by}, node, pos, bin, gl::double*gl/nl + (ga-gl)::double*(ga-gl)/(na-nl) - ga::double*ga/na gain
                from c{t}_{d} where nl < na"""
            views[s] = f"""select {by}, node, pos, bin, gain from g{t}_{d} where gain > 1e-9
                qualify row_number() over (partition by {by}, node order by gain desc, pos, bin) = 1"""
            views[f"n{t}_{d + 1}"] = f"""select a.* exclude (node), case when s.pos is null then a.node
                else 2*a.node + (b[s.pos+1] > s.bin)::int end node from {n} a left join {s} s using (k, h, node)"""
            gains.append(f"select {by}, pos, gain from {s}")
        views[f"l{t}"] = f"select {by}, node, median(y-pred) m from n{t}_{DEPTH} group by all"
        views[f"p{t + 1}"] = f"select a.* exclude (node, pred), pred + {RATE}*m pred from n{t}_{DEPTH} a join l{t} using (k, h, node)"
    views["gs"] = f"select {by}, pos, sum(gain) gain from (" + " union all ".join(gains) + ") group by all"
    views["im"] = f"""select {by}, 'f' || (pos+1) feature, coalesce(100*gain/sum(gain) over (partition by {by}), 0) importance
        from (select * from s0, range(8) f(pos)) left join gs using ({by}, pos)"""
    return views


SQL_TREES = with_views(["fx_factors"], **_tree_views("label", H)) + f"""
SELECT k AS label, feature, h AS horizon, {r6('importance')} FROM im"""
SQL_TREE_ERRORS = with_views(["fx_factors"], **_tree_views("label", H), er=f"""select k, h, avg(abs(y-pred)) error, avg(abs(y-start)) base_error
    from p{TREES} group by all""") + f"""
SELECT k AS label, h AS horizon, {r6('error', 'base_error')} FROM er"""
SQL_BOOSTED = with_views(["fx_factors"], **_tree_views("0", (1,))) + f"""
SELECT vec_id, {r6('y')}, {cut('pred', 'prediction')} FROM p{TREES}"""


def _lasso(spark, sf, keys=()):
    """Coefficients, penalty and error of the lasso path over consecutive folds."""
    made_of = factors(spark, sf).withColumns({"y": 2 * F.col("f2") - F.col("f7") + F.col("r") / 2, "label": F.col("label").cast("long")})
    return report(gram.lasso(made_of, FEATURES, "y", folds=5, order="vec_id", keys=keys))


def lasso(spark, sf):
    return _lasso(spark, sf)


def lasso_labels(spark, sf):
    """The same for each label by itself."""
    return _lasso(spark, sf, ["label"])


def _lasso_sql(key: str) -> str:
    """The path by coordinate descent in SQL: 60 sweeps from zero for each key, fold left out and penalty."""
    name = "label, " if key != "0" else ""
    xs = ", ".join(f"f{i}" for i in range(1, 9))
    return with_views(
        ["fx_factors"],
        d=f"""select {key}::bigint k, vec_id, 2*f2-f7+r/2 y, [{xs}] x, cast(floor((vec_id-min(vec_id) over ())*5/
            (max(vec_id) over ()-min(vec_id) over ()+1)) as int) fold from fx_factors""",
        u="select k, vec_id, fold, y, unnest(x) v, generate_subscripts(x, 1) j from d",
        m="select k, j, avg(v) a, stddev_pop(v) s from u group by all",
        z="""select k, vec_id, fold, any_value(y) - avg(any_value(y)) over (partition by k) y, list((v-a)/s order by j) z
            from u join m using (k, j) group by k, vec_id, fold""",
        # Rows that a path is fitted on: all but a fold, or (fold -1) all.
        t="select k, h, z.y, z.z from z, range(-1, 5) r(h) where h = -1 or fold <> h",
        e="select k, h, y, unnest(z) v, generate_subscripts(z, 1) j, z from t",
        c="select k, h, j, covar_pop(v, y) c from e group by all",
        g="""select k, h, j, i, covar_pop(v, w) g from (select k, h, j, v, unnest(z) w, generate_subscripts(z, 1) i from e) group by all""",
        gj="select k, h, j, list(g order by i) row from g group by all",
        f="select k, h, list(row order by j) gram, list(c order by j) cr from gj join c using (k, h, j) group by k, h",
        top="select k, max(abs(c)) top from c where h = -1 group by k",
        **{"path(k, h, i, alpha, step, w)": """select k, h, i, top * pow(0.001, i/99), 0, [0.0::double for q in range(8)]
                from f join top using (k), range(100) r(i)
            union all select k, h, i, alpha, step+1, [case when q = j then sign(nu)*greatest(abs(nu)-alpha, 0)/gram[j][j] else w[q] end
                for q in range(1, 9)]
            from (select p.*, gram, step % 8 + 1 j, cr[step % 8 + 1] - list_dot_product(gram[step % 8 + 1], w)
                + gram[step % 8 + 1][step % 8 + 1] * w[step % 8 + 1] nu from path p join f using (k, h) where step < 480)"""},
        done="select k, h, i, alpha, w from path where step = 480",
        b="select k, h, list(a order by j) mu, any_value(b) nu from (select k, h, j, avg(v) a, avg(y) b from e group by all) group by k, h",
        err="""select k, h, i, avg(pow((z.y - nu) - list_dot_product(w, [z.z[q] - mu[q] for q in range(1, 9)]), 2)) e
            from done join b using (k, h) join z using (k) where z.fold = h group by all""",
        best="select k, arg_min(i, (e, i)) i, min(e) e from (select k, i, avg(e) e from err group by all) group by k",
        o="""select k, alpha penalty, e error, unnest(w) coefficient, 'f' || generate_subscripts(w, 1) feature
            from done join best using (k, i) where h = -1""",
    ).replace("WITH", "WITH RECURSIVE", 1) + f"""
SELECT {"k label, " if name else ""}feature, {r6('coefficient', 'penalty', 'error')} FROM o"""


def vectors(spark, sf):
    made = sampling.feature_vectors(factors(spark, sf).where("label = 3"), FEATURES, ["vec_id", "label"])
    return report(made.select("vec_id", "label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(8)]))


SQL_VECTORS = with_views(["fx_factors"]) + "\nSELECT vec_id, label, " + ", ".join(
    cut(f"f{i + 1}", f"x{i}") for i in range(8)) + " FROM fx_factors WHERE label = 3"


def pairs(spark, sf):
    series = Ordered.on_steps(factors(spark, sf), [], "vec_id")
    made = sampling.supervised_pairs(series, FEATURES, "mark_price")
    return report(made.select("vec_id", "y", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(8)]))


SQL_PAIRS = with_views(["fx_factors"], p="select vec_id, lead(mark_price) over (order by vec_id)-mark_price y, "
                       + ", ".join(f"f{i + 1} x{i}" for i in range(8)) + " from fx_factors") + f"""
SELECT vec_id, {r6('y', *[f'x{i}' for i in range(8)])} FROM p WHERE y IS NOT NULL"""


def clipped(spark, sf):
    return report(sampling.clip(factors(spark, sf), "r", 0.2, 0.8, "clipped"), "vec_id", "clipped")


SQL_CLIPPED = with_views(["fx_factors"], c="""select vec_id, least(greatest(r, quantile_cont(r,0.2) over ()),
    quantile_cont(r,0.8) over ()) clipped from fx_factors""") + f"\nSELECT vec_id, {r6('clipped')} FROM c"


def histogram(spark, sf):
    table, _ = sampling.histogram(factors(spark, sf), "r", 20)
    return report(table)


HIST_VIEWS = {
    "b": "select min(r) lo, (max(r)-min(r))/20 w, count(*) c from fx_factors",
    "k": "select least(cast(floor((r-lo)/w) as bigint), 19) bin, count(*) n from fx_factors, b group by 1",
    "hg": """select g.bin, lo+g.bin*w "start", lo+(g.bin+1)*w stop, coalesce(n,0) n, coalesce(n,0)/(c*w) density
        from (select unnest(range(20)) bin) g cross join b left join k on k.bin=g.bin""",
}
SQL_HISTOGRAM = with_views(["fx_factors"], **HIST_VIEWS) + f"""
SELECT bin, n, {r6('"start"', 'stop', 'density')} FROM hg"""


def densest(spark, sf):
    return report(sampling.densest_bin(factors(spark, sf), "r", 20), "vec_id", "r")


SQL_DENSEST = with_views(
    ["fx_factors"], **HIST_VIEWS, best='select "start", stop from hg order by n desc, bin limit 1',
) + f"\nSELECT vec_id, {r6('r')} FROM fx_factors, best WHERE r > \"start\" AND r < stop"


def described(spark, sf):
    return report(resample.describe(factors(spark, sf), FEATURES))


SQL_DESCRIBED = with_views(
    ["fx_factors"],
    u=" union all ".join(f"select '{f}' feature, {f} v from fx_factors" for f in FEATURES),
    d="""select feature, count(*) "count", avg(v) mean, stddev_samp(v) std, min(v) "min", quantile_cont(v,0.25) q25,
        quantile_cont(v,0.5) q50, quantile_cont(v,0.75) q75, max(v) "max" from u group by feature""",
) + f"""
SELECT feature, "count", {r6('mean', 'std', '"min"', 'q25', 'q50', 'q75', '"max"')} FROM d"""


def _bar_rows(spark, sf):
    bars = settle(hourly_bars(spark, sf).select("symbol", "bucket", "close", "volume"), "bars")
    series = Ordered.on_grid(bars, ["symbol"], "bucket", HOUR)

    def frames(w):
        made = {f"ma_{n}": F.avg("close").over(w.rowsBetween(1 - n, 0)) / F.col("close") for n in (6, 24)}
        full = {k: F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, made[k]) for k, n in (("ma_6", 6), ("ma_24", 24))}
        return full | {f"target_{h}": F.lead("close", h).over(w) - F.col("close") for h in H}

    return series.with_frames(frames, back=24, ahead=max(H)).done()


def bar_coefficients(spark, sf):
    """Flagship: raw ticks to hourly bars, rolling means, forward targets, coefficients."""
    return report(selection.information_coefficients(_bar_rows(spark, sf), ["ma_6", "ma_24", "volume"], H))


def symbol_coefficients(spark, sf):
    """The same for each symbol by itself."""
    return report(selection.information_coefficients(_bar_rows(spark, sf), ["ma_6", "ma_24", "volume"], H, ["symbol"]))


def _bar_sql(by: str = "") -> str:
    ma = ", ".join(
        f"""case when count(*) over f{n} = {n} then avg("close") over f{n} / "close" end ma_{n}""" for n in (6, 24))
    names = ("ma_6", "ma_24", "volume")
    return with_views(
        ["fx_bars"],
        t=f"""select symbol, {ma}, volume, {', '.join(f'lead("close",{h}) over w-"close" target_{h}' for h in H)} from fx_bars
            window w as (partition by symbol order by bucket),
            f6 as (partition by symbol order by bucket rows between 5 preceding and current row),
            f24 as (partition by symbol order by bucket rows between 23 preceding and current row)""",
        w=f"select {by}" + ", ".join(f"corr({f}, target_{h}) {f}_{h}" for f in names for h in H) + " from t"
        + (" group by symbol" if by else ""),
        i=" union all ".join(f"select {by}'{f}' feature, {h} horizon, {f}_{h} ic from w" for f in names for h in H),
    ) + f"\nSELECT {by}feature, horizon, {r6('ic')} FROM i"


def described_labels(spark, sf):
    return report(resample.describe(factors(spark, sf).withColumn("label", F.col("label").cast("long")), FEATURES, ["label"]))


SQL_DESCRIBED_LABELS = with_views(
    ["fx_factors"],
    u=" union all ".join(f"select label, '{f}' feature, {f} v from fx_factors" for f in FEATURES),
    d="""select cast(label as bigint) AS label, feature, count(*) "count", avg(v) mean, stddev_samp(v) std, min(v) "min",
        quantile_cont(v,0.25) q25, quantile_cont(v,0.5) q50, quantile_cont(v,0.75) q75, max(v) "max" from u group by all""",
) + f"""
SELECT label, feature, "count", {r6('mean', 'std', '"min"', 'q25', 'q50', 'q75', '"max"')} FROM d"""


def role_split(spark, sf):
    """Environment and feature columns by name lists, as set differences of names."""
    df = factors(spark, sf)
    roles = ["vec_id", "label", "mark_price", "r"]
    features = [c for c in df.columns if c not in roles]
    total = sum((F.col(c) for c in features[1:]), F.col(features[0]))
    return report(df.select("vec_id", "mark_price", total.alias("feature_sum"), F.lit(len(features)).alias("n_features")))


SQL_ROLES = with_views(["fx_factors"], s="select vec_id, mark_price, f1+f2+f3+f4+f5+f6+f7+f8 s from fx_factors") + f"""
SELECT vec_id, {r6('mark_price')}, {cut('s', 'feature_sum')}, 8 n_features FROM s"""

QUERIES = {
    "bar_coefficients": (bar_coefficients, _bar_sql()),
    "symbol_coefficients": (symbol_coefficients, _bar_sql("symbol, ")),
    "describe_labels": (described_labels, SQL_DESCRIBED_LABELS),
    "forward_targets": (targets, SQL_TARGETS),
    "information_coefficients": (coefficients, SQL_COEFFICIENTS),
    "rank_coefficients": (rank_coefficients, SQL_RANK),
    "rank_labels": (rank_labels, SQL_RANK_LABELS),
    "correlation_labels": (label_matrix, SQL_LABEL_MATRIX),
    "label_features": (label_features, SQL_LABEL_FEATURES),
    "scaled_labels": (label_scaled, _label_scaled_sql()),
    "threshold_selection": (thresholds, SQL_THRESHOLDS),
    "correlation_matrix": (matrix, SQL_MATRIX),
    "pruned_selection": (pruned, SQL_PRUNED),
    "repruned_selection": (repruned, SQL_REPRUNED),
    "power_of_ten_scale": (scaled, _scaled_sql()),
    "tree_importance": (trees, SQL_TREES),
    "tree_errors": (tree_errors, SQL_TREE_ERRORS),
    "boosted_prediction": (boosted, SQL_BOOSTED),
    "lasso_features": (lasso, _lasso_sql("0")),
    "lasso_labels": (lasso_labels, _lasso_sql("label")),
    "feature_vectors": (vectors, SQL_VECTORS),
    "supervised_pairs": (pairs, SQL_PAIRS),
    "clipped_values": (clipped, SQL_CLIPPED),
    "histogram": (histogram, SQL_HISTOGRAM),
    "densest_bin": (densest, SQL_DENSEST),
    "describe_factors": (described, SQL_DESCRIBED),
    "role_split": (role_split, SQL_ROLES),
}

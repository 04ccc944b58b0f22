"""The input views of the registered queries, once per engine.

Each view reads a given table; ``SQL`` holds the same view for the DuckDB check.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import resample
from barloom.operators.dedup import row_ids
from barloom.operators.ordering import Ordered, running_sum
from barloom.session import configure, settle

HOUR = 3600


# Schemas by path: reading one is a job of its own. No data is kept.
_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    reader = configure(spark).read
    if path not in _SCHEMAS:
        _SCHEMAS[path] = reader.parquet(path).schema
    return reader.schema(_SCHEMAS[path]).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumns({"symbol": F.col("event_type"), "ts": F.col("ts").cast("timestamp")})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "symbol", "ts", F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("amount"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "symbol", "ts", "event_id", F.col("value").alias("bid_price"),
        (F.col("value") + (1 + F.col("user_id") % 5) / F.lit(100.0)).alias("ask_price"),
        (1 + F.col("user_id") % 10).cast("double").alias("bid_amount"),
        (1 + F.col("event_id") % 7).cast("double").alias("ask_amount"),
    )


def ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = (F.floor(F.hour("ts") / 8) * 8 + 8).cast("int")
    return _events(spark, sf_dir).select(
        "symbol", "ts", "event_id", F.col("value").alias("mark_price"),
        F.col("value").alias("index_price"),
        ((F.col("event_id") % 21 - 10) / F.lit(100000.0)).alias("funding_rate"),
        (F.date_trunc("day", "ts") + F.make_dt_interval(F.lit(0), shift)).alias("funding_timestamp"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    def price(sign: float):
        return F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: 100.0 + sign * (i + 1) * 0.5)

    def size(start: int):
        return F.transform(
            F.slice("embedding", start, 25), lambda v: F.abs(v.cast("double")) + F.lit(1.0)
        )

    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("symbol"), F.col("vec_id").alias("book_id"),
        F.timestamp_seconds(1704067200 + F.col("vec_id") * 300).alias("ts"),
        price(1.0).alias("ask_price"), price(-1.0).alias("bid_price"),
        size(1).alias("ask_size"), size(26).alias("bid_size"),
    )


FEATURES = tuple(f"f{i}" for i in range(1, 9))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def at(i: int):
        return F.get("embedding", F.lit(i - 1)).cast("double")

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", *[at(i).alias(f"f{i}") for i in range(1, 9)],
        (at(9) + F.col("label")).alias("mark_price"), at(10).alias("r"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return table(spark, sf_dir, "embeddings").withColumn("model", models).select(
        F.col("vec_id").alias("step"), "model",
        F.get("embedding", F.col("model")).cast("double").alias("score"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("y_true"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run_id"), "o_orderdate", "o_orderkey",
        (F.col("o_orderkey") % 201 - 100).cast("double").alias("reward"),
        (F.col("o_custkey") % 9).cast("int").alias("action"),
    )
    numbered = row_ids(orders, ["run_id"], ["o_orderdate", "o_orderkey"], "step")
    return numbered.select("run_id", (F.col("step") + 1).alias("step"), "reward", "action")


def ledger(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """Account columns of the runs; ``log`` passes settled runs where they are used again."""
    series = Ordered.on_steps(log or settle(runs(spark, sf_dir), "runs"), ["run_id"], "step")
    return series.running(_sum=running_sum(F.col("reward"))).done().select(
        "run_id", "step", (100000 + F.col("_sum")).alias("wallet"),
        (F.col("action") * 10 - 40).cast("double").alias("unrealized"),
        (F.col("action") * 50).cast("double").alias("initial_margin"),
        (F.col("action") * 10).cast("double").alias("maintenance"),
        ((F.col("step") % 7) * 20).cast("double").alias("need"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("initial_action"),
        (F.col("l_suppkey") % 5).cast("int").alias("bin_index"),
        (F.col("l_partkey") % 10).cast("int").alias("epoch"),
        (F.col("l_extendedprice") - 20000).alias("reward_sum"),
        F.col("l_quantity").alias("df_length"),
    )


# Margin tiers (lower bound, upper bound, ratio, deduction).
TIERS = ((0.0, 50000.0, 0.004, 0.0), (50000.0, 500000.0, 0.005, 50.0), (500000.0, None, 0.01, 2550.0))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly trade bars on the full grid."""
    sparse = resample.trade_bars(trades(spark, sf_dir), HOUR)
    return resample.complete_bars(sparse, HOUR, resample.zero_columns(sparse))


SQL = {
    "fx_trades": """select event_type symbol, ts, event_id id,
        case when user_id%2=0 then 'buy' else 'sell' end side, value price,
        cast(1+user_id%10 as double) amount from events""",
    "fx_quotes": """select event_type symbol, ts, event_id, value bid_price,
        value+cast(1+user_id%5 as double)/cast(100 as double) ask_price,
        cast(1+user_id%10 as double) bid_amount, cast(1+event_id%7 as double) ask_amount from events""",
    "fx_ticker": """select event_type symbol, ts, event_id, value mark_price, value index_price,
        cast(event_id%21-10 as double)/cast(100000 as double) funding_rate,
        date_trunc('day',ts)+to_hours(cast(floor(hour(ts)/8) as int)*8+8) funding_timestamp from events""",
    "fx_book": """select label symbol, vec_id book_id,
        make_timestamp((1704067200+vec_id*300)*1000000) ts,
        [100+(i+1)*0.5::double for i in range(25)] ask_price,
        [100-(i+1)*0.5::double for i in range(25)] bid_price,
        [abs(v::double)+1 for v in embedding[1:25]] ask_size,
        [abs(v::double)+1 for v in embedding[26:50]] bid_size from embeddings""",
    "fx_factors": "select vec_id, label, "
    + ", ".join(f"cast(embedding[{i}] as double) f{i}" for i in range(1, 9))
    + ", cast(embedding[9] as double)+cast(label as double) mark_price, "
    "cast(embedding[10] as double) r from embeddings",
    "fx_scores": """select vec_id step, m model, cast(embedding[m+1] as double) score,
        case when label<5 then 1 else 0 end y_true
        from embeddings cross join (values (0),(1),(2),(3),(4)) t(m)""",
    "fx_runs": """select o_orderpriority run_id,
        row_number() over (partition by o_orderpriority order by o_orderdate,o_orderkey) step,
        cast(o_orderkey%201-100 as double) reward, cast(o_custkey%9 as int) action from orders""",
    "fx_ledger": """select run_id, step, 100000+sum(reward) over (partition by run_id order by step) wallet,
        cast(action*10-40 as double) unrealized, cast(action*50 as double) initial_margin,
        cast(action*10 as double) maintenance, cast((step%7)*20 as double) need from fx_runs""",
    "fx_trials": """select l_returnflag label, l_linenumber initial_action,
        cast(l_suppkey%5 as int) bin_index, cast(l_partkey%10 as int) epoch,
        l_extendedprice-20000 reward_sum, l_quantity df_length from lineitem""",
    "fx_tiers": """select * from (values (cast(0 as double),cast(50000 as double),cast(0.004 as double),
        cast(0 as double)),(50000,500000,0.005,50),(500000,null,0.01,2550)) t(lo,hi,ratio,deduction)""",
    "fx_gaps": """select *, epoch_us(ts) us, date_trunc('hour', ts) bucket,
        epoch_us(ts)-lag(epoch_us(ts)) over s dus, price-lag(price) over s move
        from fx_trades window s as (partition by symbol order by ts, id)""",
    "fx_sparse": """select symbol, bucket, arg_min(price, us) "open", max(price) high, min(price) low,
        arg_max(price, us) "close", sum(amount) volume, sum(price*amount) tradeval, count(*) ntrade,
        sum(price*amount)/sum(amount) vwap, avg(price) awap,
        sum(price*dus)/nullif(sum(dus),0) twap,
        count(*) filter (move>0) ntrade_up, count(*) filter (move<0) ntrade_down,
        count(*) filter (move=0) ntrade_flat from fx_gaps group by symbol, bucket""",
    "fx_grid": """select symbol, unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) bucket
        from fx_sparse group by symbol""",
    "fx_bars": """select g.symbol, g.bucket, """
    + ", ".join(
        f'last_value({c} ignore nulls) over w as {c}'
        for c in ('"open"', "high", "low", '"close"', "vwap", "awap", "twap")
    )
    + ", " + ", ".join(
        f"coalesce({c},0) {c}"
        for c in ("volume", "tradeval", "ntrade", "ntrade_up", "ntrade_down", "ntrade_flat")
    )
    + """ from fx_grid g left join fx_sparse s using (symbol, bucket)
        window w as (partition by g.symbol order by g.bucket)""",
}

NEEDS = {
    "fx_ledger": ["fx_runs"], "fx_gaps": ["fx_trades"], "fx_sparse": ["fx_gaps"],
    "fx_grid": ["fx_sparse"], "fx_bars": ["fx_grid", "fx_sparse"],
}


def with_views(names: Iterable[str], **more: str) -> str:
    """``WITH`` clause holding the named views, what they need, then ``more``."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        ordered.setdefault(name, SQL[name])

    for name in names:
        add(name)
    ordered |= more
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ordered.items())


# Reported doubles are cut to a grid of 1e-6, off the half so that values of few
# decimals never lie on a cut; large ones to single precision.
DIGITS, SHIFT, LARGE = 1000000, 0.5371, 1000000


def report(df: DataFrame, *columns: str) -> DataFrame:
    """Query output: doubles on the grid, timestamps as epoch microseconds."""
    picked = df.select(*columns) if columns else df
    out = []
    for f in picked.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.DoubleType):
            out.append(
                f"CASE WHEN abs({name}) < {LARGE} THEN floor({name} * {DIGITS}D + {SHIFT}D) / {DIGITS}D "
                f"ELSE CAST(CAST({name} AS FLOAT) AS DOUBLE) END AS {name}")
        elif isinstance(f.dataType, T.TimestampType):
            out.append(f"unix_micros({name}) AS {name}")
        else:
            out.append(name)
    return picked.selectExpr(*out)


def r6(*names: str) -> str:
    """SQL for doubles on the same grid."""
    return ", ".join(cut(n, n) for n in names)


def cut(value: str, name: str) -> str:
    return (f"case when abs({value}) < 1e6 then cast(floor(({value})*1e6+0.5371) as bigint)/1e6 "
            f"else cast(cast({value} as float) as double) end AS {name}")

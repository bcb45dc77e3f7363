"""More queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.windows import ln
from tidemark.operators import backtest, bars, cross_section, factors, governance, inference, integrity, portfolio, regimes, returns, signals, universe
from tidemark.plans import inputs, scan
from tidemark.plans.catalog import _ALLOW, _FEAT, _IC, _LS, _MOM3, _PAIRS, _RANK, _REG, _W24, BARS, CORR, MARKET, RET, TICKS, WIDE, _allowlist, _momentum3, _pairs, _r, _series, query, rounded
from tidemark.sources import loaders, sinks

# --- scalars ------------------------------------------------------------------------------------


@query(
    "pair_flags",
    f"""with {_PAIRS} select pair_address, base_symbol in ('USDC', 'USDT', 'DAI') and quote_symbol in ('USDC', 'USDT', 'DAI') as is_stable, 'BTC/' || quote_symbol in ('BTC/T1', 'BTC/SOL') as is_btc, round(case when liquidity_usd > 0 then ln(liquidity_usd) end, 6) as log_liquidity,
 try_cast(base_symbol as double) as number, 'eth' as chain, pair_address as address, 2 as n_tags from pr""",
)
def pair_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    chain, address = scalars.pair_parts(F.concat(F.lit("eth:"), c("pair_address")))
    label = F.when(c("quote_symbol") == "USDT", F.lit("ETH/USDT")).otherwise(F.concat(F.lit("wbtc/"), c("quote_symbol")))
    tags = scalars.parse_tags(F.concat(c("pair_address"), F.lit(", ,x ")))
    return rounded(_pairs(spark, sf).select("pair_address", scalars.is_stable_pair(c("base_symbol"), c("quote_symbol")).alias("is_stable"), scalars.is_btc_pair(label).alias("is_btc"), ln(c("liquidity_usd")).alias("log_liquidity"), scalars.to_float(c("base_symbol")).alias("number"), chain.alias("chain"), address.alias("address"), F.size(tags).alias("n_tags")))


@query(
    "metric_states",
    """with e as (select event_id, value / 20 as s, case when event_id % 9 > 0 then value / 25 + (event_id % 5) / 10.0 end as l from events)
 select event_id, case when l is null then 'unknown' when s - l < -0.15 then 'compressed' when s - l > 0.15 then 'expanded' else 'stable' end as beta_state,
 case when l is null or l <= 0 then 'unknown' when s / l >= 1.25 then 'rising' when s / l <= 0.75 then 'falling' else 'stable' end as vol_regime, round(s * sqrt(8760), 5) as sharpe_annual,
 case event_id % 3 when 0 then 'Volatility and betas are stable; prices move within a range.' when 1 then 'Assets move apart; relative value matters.' else 'The inputs give no regime.' end as text from e""",
)
def metric_states(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    e = inputs.table(spark, sf, "events").select("event_id", (F.col("value") / 20).alias("s"), F.when(i % 9 > 0, F.col("value") / 25 + (i % 5) / 10.0).alias("l"))
    regime = F.when(i % 3 == 0, "chop").when(i % 3 == 1, "dispersion").otherwise("none")
    s, l_ = F.col("s"), F.col("l")
    return e.select("event_id", scalars.beta_state(s, l_).alias("beta_state"), scalars.vol_regime(s, l_).alias("vol_regime"), F.round(scalars.annualize_sharpe(s, "1h"), 5).alias("sharpe_annual"), scalars.explain_regime(regime).alias("text"))


# --- sources ------------------------------------------------------------------------------------


@query("venue_bars", f"with {BARS}, n as (select asset from bars where asset in ('click', 'view') and close > 0 group by 1 having count(*) >= 30) select asset, ts, round(close, 6) as close from bars where close > 0 and asset in (select asset from n)")
def venue_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(loaders.bars(inputs.bars(spark, sf), 30, ["click", "view"]).select("asset", "ts", "close"))


@query("stored_returns", f"with {RET}, s as (select asset, ts, close, case when asset = 'click' then null else log_return + 1 end as stored, log_return from ret) select asset, ts, round(case when asset = 'click' then log_return else stored end, 6) as log_return from s")
def stored_returns(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.returns(spark, sf).withColumn("log_return", F.when(F.col("asset") != "click", F.col("log_return") + 1))
    return rounded(loaders.stored_or_derived_returns(r).select("asset", "ts", "log_return"))


@query("market_asset", "select 'BTC_spot' as asset")
def market_asset(spark: SparkSession, sf: str) -> DataFrame:
    n = inputs.table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 3, "BTC_spot").when(F.col("n_nationkey") == 4, "WBTC/USDC").otherwise(F.col("n_name")).alias("asset"))
    return loaders.factor_asset(n)


@query("sane_assets", f"with {WIDE} select asset from wide group by 1 having count(log_return) >= 2 and stddev_samp(log_return) > 0")
def sane_assets(spark: SparkSession, sf: str) -> DataFrame:
    return loaders.sane_assets(inputs.wide(spark, sf))


@query("candle_points", "select cast(o_orderdate as timestamp) as ts, round(case o_orderkey % 3 when 0 then o_totalprice when 1 then (10 + 4) / 2.0 else 0.0 end, 4) as price, cast(o_custkey as double) as volume from orders")
def candle_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    time = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")
    prices = F.when(k == 0, F.concat(F.lit('"c":'), F.col("o_totalprice").cast("string"), F.lit(","))).when(k == 1, '"o":10,"l":4,').otherwise("")
    body = F.concat(F.lit('{"success":true,"data":{"items":[{"unixTime":'), time, F.lit(","), prices, F.lit('"v":'), F.col("o_custkey").cast("string"), F.lit("}]}}"))
    failed = F.lit('{"success":false,"data":{"items":[{"unixTime":1}]}}')
    o = inputs.table(spark, sf, "orders").select(body.alias("payload"))
    return rounded(loaders.candle_points(o.unionByName(o.limit(1).select(failed.alias("payload")))).select("ts", "price", "volume"), 4)


@query("pair_payloads", "select 's' || s_suppkey as pair_address, case when s_suppkey % 2 = 0 then 'A' else 'B' end as base_symbol, case when s_suppkey % 5 > 0 then round(abs(s_acctbal), 2) end as dex_price_usd, cast(s_suppkey as double) as liquidity_usd from supplier where s_suppkey % 7 > 0")
def pair_payloads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    price = F.when(k % 5 > 0, F.round(F.abs("s_acctbal"), 2).cast("string")).otherwise("n/a")
    pair = F.concat(F.lit('{"chainId":"c","pairAddress":"s'), k.cast("string"), F.lit('","baseToken":{"symbol":"'), F.when(k % 2 == 0, "A").otherwise("B"), F.lit('"},"priceUsd":"'), price, F.lit('","liquidity":{"usd":'), k.cast("string"), F.lit("}}"))
    body = F.when(k % 7 == 0, "{}").when(k % 3 == 0, F.concat(F.lit('{"pair":'), pair, F.lit("}"))).otherwise(F.concat(F.lit('{"pairs":['), pair, F.lit(',{"chainId":"other"}]}')))
    s = inputs.table(spark, sf, "supplier").select(F.lit(0).alias("ts"), body.alias("payload"))
    return rounded(loaders.pair_snapshots(s).select("pair_address", "base_symbol", "dex_price_usd", "liquidity_usd"), 4)


@query(
    "provider_fallback",
    """with q as (select event_type as asset, date_trunc('minute', ts) as ts, case user_id % 2 when 0 then 'first' else 'second' end as provider, max(case when user_id % 5 > 1 then value end) as price from events group by 1, 2, 3),
 b as (select asset, ts, coalesce(max(case when provider = 'first' and price > 0 then price end), max(case when provider = 'second' and price > 0 then price end)) as v, case when max(case when provider = 'first' and price > 0 then price end) is not null then 'first' when max(case when provider = 'second' and price > 0 then price end) is not null then 'second' end as p from q group by 1, 2),
 k as (select asset, ts, v is null as stale, last_value(case when v is not null then {'v': v, 'p': p} end ignore nulls) over (partition by asset order by ts range between interval 7200 seconds preceding and current row) as k from b)
 select asset, ts, round(k.v, 6) as price, coalesce(k.p, 'none') as provider, stale from k""",
)
def provider_fallback(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events")
    q = e.groupBy(F.col("event_type").alias("asset"), F.date_trunc("minute", "ts").alias("ts"), F.when(F.col("user_id") % 2 == 0, "first").otherwise("second").alias("provider")).agg(F.max(F.when(F.col("user_id") % 5 > 1, F.col("value"))).alias("price"))
    return rounded(loaders.fallback(q, ["first", "second"], 7200))


@query("healthy_rows", "select event_id, round(value, 4) as price, case when value > 0 then 'OK' end as quality from events where value > 0")
def healthy_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "events").select("event_id", F.col("value").alias("price"))
    out = sinks.provenance(e, "p", F.lit("2024-01-01").cast("timestamp"), "DOWN")
    return rounded(out.select("event_id", "price", F.lit("OK").alias("quality")), 4)


# --- integrity ----------------------------------------------------------------------------------


@query("bad_prices", "select 'events' as \"table\", 'value' as \"column\", count(*) as bad from events where (value - 5) <= 0 having count(*) > 0")
def bad_prices(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.non_positive(inputs.table(spark, sf, "events").withColumn("value", F.col("value") - 5), ["value", "event_id"], "events").where("column = 'value'")


@query("looks_ahead", f"with {RET}, f as (select ts, lead(log_return) over (partition by asset order by ts) as fwd from ret where log_return is not null) select (select max(ts) from ret) > (select max(ts) from f where fwd is not null) as looks_ahead")
def looks_ahead(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.returns(spark, sf)
    return integrity.looks_ahead(r, returns.forward_return(r, 1).where("fwd is not null"))


@query("panel_overlap", f"with {RET}, n as (select count(distinct ts) as n from ret where log_return is not null) select unnest([1, 24, 100000]) as horizon, n as n_common, n - unnest([1, 24, 100000]) >= 2 as ok from n")
def panel_overlap(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.returns(spark, sf).where("log_return is not null")
    return integrity.overlap(r, r.select("ts"), [1, 24, 100_000])


@query("quality_filtered", f"with {WIDE}, q as (select * from wide where liquidity_usd >= 10 and volume >= 5), n as (select asset from q group by 1 having count(*) >= 5) select asset, ts, round(close, 4) as close from q where asset in (select asset from n)")
def quality_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(integrity.quality_filter(inputs.wide(spark, sf), 10, 5, 5, volume="volume").select("asset", "ts", "close"), 4)


# --- time series --------------------------------------------------------------------------------


@query("equity_drawdowns", f"with {RET}, e as (select asset, ts, exp(sum(coalesce(log_return, 0)) over (partition by asset order by ts)) as equity from ret) select asset, ts, round(equity / max(equity) over (partition by asset order by ts) - 1, 6) as drawdown from e")
def equity_drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = inputs.returns(spark, sf).withColumn("equity", F.exp(F.sum(F.coalesce("log_return", F.lit(0.0))).over(w)))
    return rounded(e.select("asset", "ts", returns.drawdown_of_equity(F.col("equity")).alias("drawdown")))


@query("recomputed_returns", f"with {BARS}, b as (select asset, ts, case when close > 3 then close end as close from bars) select asset, ts, round(case when close > 0 and lag(close) over (partition by asset order by ts) > 0 then ln(close) - ln(lag(close) over (partition by asset order by ts)) end, 6) as log_return from b")
def recomputed_returns(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf).withColumn("close", F.when(F.col("close") > 3, F.col("close")))
    return rounded(bars.recomputed_returns(b).select("asset", "ts", "log_return"))


@query("liquidity_changes", f"with {BARS} select asset, ts, round(case when lag(liquidity_usd, 24) over w <> 0 then liquidity_usd / lag(liquidity_usd, 24) over w - 1 end, 6) as liquidity_change from bars window w as (partition by asset order by ts)")
def liquidity_changes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inputs.bars(spark, sf).select("asset", "ts", returns.change(F.col("liquidity_usd"), 24).alias("liquidity_change")))


@query(
    "bar_features",
    f"""with {RET}, c as (select *, exp(sum(log_return) over (partition by asset order by ts)) - 1 as cum from ret)
 select asset, ts, round(case when log_return is not null then cum end, 6) as cum_return, round(case when count(log_return) over a = 24 then exp(sum(log_return) over a) - 1 end, 6) as return_24h, round(case when count(log_return) over b = 72 then exp(sum(log_return) over b) - 1 end, 6) as return_3d,
 round(case when lag(liquidity_usd, 24) over w <> 0 then liquidity_usd / lag(liquidity_usd, 24) over w - 1 end, 6) as liquidity_change from c window w as (partition by asset order by ts), a as (partition by asset order by ts rows 23 preceding), b as (partition by asset order by ts rows 71 preceding)""",
)
def bar_features(spark: SparkSession, sf: str) -> DataFrame:
    f = returns.add_features(inputs.bars(spark, sf), "1h", 24, liquidity="liquidity_usd")
    return rounded(f.select("asset", "ts", "cum_return", "return_24h", "return_3d", "liquidity_change"))


@query("excess_lookback", f"""with {MARKET}, o as (select * from mk where log_return is not null), b as (select asset, covar_samp(log_return, factor) / var_samp(factor) as beta from o group by 1), x as (select o.asset, ts, log_return - beta * factor as excess, row_number() over (partition by o.asset order by ts desc) as rn from o join b using (asset))
 select asset, round(case when count(excess) = 24 then exp(sum(excess)) - 1 end, 6) as lookback_return from x where rn <= 24 group by 1""")
def excess_lookback(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.returns(spark, sf)
    f = r.where("asset = 'click'")
    x = returns.excess_returns(r, f, factors.beta(returns.with_factor(r, f)))
    return rounded(returns.lookback_return(x, 24, "excess"))


# --- cross-sections and weights -----------------------------------------------------------------

_FRAME = "fr as (select ts, asset, 'a' as factor, log_return as value from wide union all select ts, asset, 'b', liquidity_usd from wide)"


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    w = inputs.wide(spark, sf)
    return w.select("ts", "asset", F.lit("a").alias("factor"), F.col("log_return").alias("value")).unionByName(w.select("ts", "asset", F.lit("b").alias("factor"), F.col("liquidity_usd").alias("value")))


@query("rank_sums", f"with {WIDE}, {_FRAME}, r as (select ts, asset, {_RANK.format(x='value', p='ts, factor')} as r from fr) select ts, asset, sum(r) as signal from r group by 1, 2")
def rank_sums(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.combine_rank_sum(_frame(spark, sf))


@query("populous_times", f"with {WIDE}, n as (select ts from wide group by 1 having count(distinct asset) >= 12) select asset, ts from wide where ts in (select ts from n)")
def populous_times(spark: SparkSession, sf: str) -> DataFrame:
    return cross_section.at_least_assets(inputs.wide(spark, sf).select("asset", "ts"), 12)


@query("wide_returns", f"with {RET} select ts, round(max(case when asset = 'click' then log_return end), 6) as click, round(max(case when asset = 'view' then log_return end), 6) as view from ret where asset in ('click', 'view') group by 1")
def wide_returns(spark: SparkSession, sf: str) -> DataFrame:
    r = inputs.returns(spark, sf).where("asset in ('click', 'view')")
    return rounded(cross_section.to_wide(r, "log_return", assets=["click", "view"]))


_LEGS = WIDE + """, n as (select asset, ts, log_return, count(*) over (partition by ts) as n, row_number() over (partition by ts order by log_return desc, asset) as up, row_number() over (partition by ts order by log_return, asset) as down from wide where log_return is not null)"""


@query("sized_weights", f"""with {_LEGS}, l as (select *, case when up <= 4 then 1 when down <= 4 then -1 else 0 end as leg from n where n >= 8), s as (select *, sum(abs(log_return)) over (partition by ts, leg) as t, count(*) over (partition by ts, leg) as c from l)
 select asset, ts, round(leg * case when t > 0 then abs(log_return) / t else 1.0 / c end / 2, 6) as weight from s""")
def sized_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return", by="log_return").select("asset", "ts", "weight"))


@query("adaptive_weights", f"""with {_LEGS}, k as (select *, least(4, greatest(1, cast(floor(n / 4) as integer))) as k from n), l as (select *, case when up <= k then 1 when down <= k then -1 else 0 end as leg from k where n >= 2 * k)
 select asset, ts, round(leg * 0.5 / count(*) over (partition by ts, leg), 6) as weight from l""")
def adaptive_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return", adaptive=True).select("asset", "ts", "weight"))


_NUM = _LS + ", tm as (select ts, row_number() over (order by ts) as n from (select distinct ts from ls)), nw as (select asset, ts, weight, n from ls join tm using (ts))"


@query("held_weights", f"with {_NUM}, h as (select asset, weight, unnest(range(n, n + 5)) as n from nw where (n - 1) % 5 = 0) select asset, ts, weight from h join tm using (n)")
def held_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.held(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return"), 5).select("asset", "ts", "weight"))


@query("weight_turnover", f"with {_NUM}, c as (select coalesce(a.n, b.n + 1) as n, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) as d from nw a full join nw b on a.asset = b.asset and a.n = b.n + 1 group by 1) select ts, round(case when n = 1 then 0 else d end, 6) as turnover from tm join c using (n)")
def weight_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.turnover(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return")))


@query("smoothed_weights", f"""with recursive {_NUM}, g as (select a.asset, t.n, t.ts, coalesce(w.weight, 0) as weight from tm t cross join (select distinct asset from ls) a left join nw w on w.asset = a.asset and w.n = t.n),
 e(asset, n, ts, s) as (select asset, n, ts, weight::double from g where n = 1 union all select g.asset, g.n, g.ts, e.s + 0.3 * (g.weight - e.s) from e join g on g.asset = e.asset and g.n = e.n + 1) select asset, ts, round(s, 6) as weight from e""")
def smoothed_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.smoothed(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return"), 0.3).select("asset", "ts", "weight"))


@query("constrained_weights", f"with {_LS} select asset, ts, greatest(-0.1, least(0.1, weight)) as weight from ls")
def constrained_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return").select("asset", "ts", portfolio.constrained(F.col("weight"), 0.1).alias("weight")))


@query("weight_concentration", f"with {_LS} select ts, round(sum(abs(weight)), 6) as gross, round(sum(weight), 6) as net, count(*) filter (weight <> 0) as n_assets, max(abs(weight)) as max_weight, round(sum(weight * weight) / pow(sum(abs(weight)), 2), 6) as herfindahl from ls group by 1")
def weight_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(portfolio.diagnostics(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return")).withColumn("n_assets", F.col("n_assets").cast("long")))


@query("order_intents", f"with {_LS} select ts, cast(count(*) as integer) as n_targets, min(asset) as first_target from ls where weight <> 0 group by 1")
def order_intents(spark: SparkSession, sf: str) -> DataFrame:
    o = portfolio.order_intent(portfolio.long_short(inputs.wide(spark, sf), 4, 4, rank="log_return"))
    return o.select("ts", F.size("targets").alias("n_targets"), F.array_min(F.map_keys("targets")).alias("first_target"))


@query(
    "optimal_weights",
    f"""with {WIDE}, v as (select *, var_samp(log_return) over (partition by asset) as variance from wide where log_return is not null), r as (select *, (({_RANK.format(x='log_return', p='ts')}) / count(*) over (partition by ts) - 0.5) * 2 as w from v),
 a as (select *, case when coalesce(liquidity_usd, 0) < 5 then 0 else w end / sqrt(greatest(coalesce(variance, 0), 1e-10)) as w1 from r), c as (select *, greatest(-0.1, least(0.1, w1)) as w2 from a),
 d as (select *, sum(w2) over (partition by ts) as t, greatest(count(*) filter (w2 <> 0) over (partition by ts), 1) as n from c), e as (select *, case when abs(t) > 1e-12 then w2 - t / n else w2 end as w3 from d), g as (select *, sum(abs(w3)) over (partition by ts) as s from e)
 select asset, ts, round(greatest(-0.1, least(0.1, case when s > 1e-12 then w3 / s else w3 end)), 6) as weight from g""",
)
def optimal_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = inputs.wide(spark, sf).where("log_return is not null").withColumn("variance", F.var_samp("log_return").over(Window.partitionBy("asset")))
    return rounded(portfolio.optimize_long_short(w, "log_return", "variance", max_weight=0.1, gross=1.0, liquidity=("liquidity_usd", 5.0)).select("asset", "ts", "weight"))


@query("exposures", f"with {RET} select asset, ts, round(case when count(log_return) over w = 24 then stddev_samp(log_return) over w end, 6) as rolling_vol, round(case when count(log_return) over w = 24 then avg(abs(log_return)) over w end, 6) as turnover_proxy, round(case when liquidity_usd > 0 then ln(liquidity_usd) end, 6) as log_liquidity from ret window w as {_W24}")
def exposures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross_section.exposure_panel(inputs.returns(spark, sf), liquidity="liquidity_usd").select("asset", "ts", "rolling_vol", "turnover_proxy", "log_liquidity"))


@query("orthogonal_signals", f"""with {WIDE}, e as (select asset, ts, log_return as x, close as y from wide), c as (select *, (x is not null and y is not null) as ok from e),
 s as (select *, count(case when ok then 1 end) over p as n, avg(case when ok then y end) over p as my, avg(case when ok then x end) over p as mx from c window p as (partition by ts)),
 b as (select *, sum(case when ok then (x - mx) * (y - my) end) over p as sxy, sum(case when ok then (x - mx) * (x - mx) end) over p as sxx from s window p as (partition by ts))
 select asset, ts, round(x, 6) as first_orth, round(case when n < 3 then y when ok then y - my - (case when sxx > 1e-18 then sxy / sxx else 0 end) * (x - mx) end, 5) as second_orth from b""")
def orthogonal_signals(spark: SparkSession, sf: str) -> DataFrame:
    w = inputs.wide(spark, sf).select("asset", "ts", F.col("log_return").alias("first"), F.col("close").alias("second"))
    return cross_section.orthogonalized(w, ["first", "second"]).select("asset", "ts", F.round("first_orth", 6).alias("first_orth"), F.round("second_orth", 5).alias("second_orth"))


@query("signal_correlations", f"with {WIDE} select 'log_return' as a, 'close' as b, round({CORR.format(x='x', y='y', w='')}, 6) as corr from (select log_return as x, close as y from wide where log_return is not null)")
def signal_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cross_section.cross_correlations(inputs.wide(spark, sf), ["log_return", "close"]))


# --- factors and signals ------------------------------------------------------------------------


@query("sample_covariance", f"with {RET}, o as (select * from ret where log_return is not null) select a.asset as a, b.asset as b, round(covar_samp(a.log_return, b.log_return), 6) as cov from o a join o b using (ts) group by 1, 2")
def sample_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(factors.estimate_covariance(inputs.returns(spark, sf), "sample"))


@query("shrunk_covariance", f"with {RET}, o as (select * from ret where log_return is not null) select a.asset as a, b.asset as b, round(covar_samp(a.log_return, b.log_return) * case when a.asset = b.asset then 1 else 0.8 end, 6) as cov from o a join o b using (ts) group by 1, 2")
def shrunk_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(factors.shrunk(factors.sample_covariance(inputs.returns(spark, sf)), 0.2))


_RES = MARKET + ", fit as (select asset, regr_slope(log_return, factor) as b, regr_intercept(log_return, factor) as a, regr_r2(log_return, factor) as r2 from mk where log_return is not null group by 1 having count(*) >= 3), res as (select mk.asset, mk.ts, log_return - (a + b * factor) as residual from mk join fit using (asset))"


@query("residual_returns", f"with {_RES} select asset, ts, round(residual, 5) as residual from res where asset <> 'click'")
def residual_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scan.residuals(inputs.with_market(spark, sf), ["factor"]).where("asset <> 'click'").select("asset", "ts", "residual"), 5)


@query("residual_vols", f"with {_RES}, v as (select asset, ts, case when count(residual) over w = 24 then stddev_samp(residual) over w end as v from res where residual is not null and asset <> 'click' window w as {_W24}) select asset, round(case when arg_max(v, ts) > 0 then arg_max(v, ts) * sqrt(8760) end, 4) as residual_vol from v group by 1")
def residual_vols(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(factors.residual_volatility(scan.residuals(inputs.with_market(spark, sf), ["factor"]).where("asset <> 'click'"), 24, "1h"), 4)


@query("residual_scan", f"with {_RES}, n as (select *, row_number() over (partition by asset order by ts desc) as rn from res where residual is not null), l as (select asset, case when count(*) = 24 then exp(sum(residual)) - 1 end as lookback_return from n where rn <= 24 and asset <> 'click' group by 1) select asset, round(lookback_return, 5) as lookback_return from l where lookback_return is not null order by l.lookback_return desc, asset limit 3")
def residual_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scan.residual_momentum(inputs.with_market(spark, sf).where("asset <> 'click'"), ["factor"], "1h", 3), 5)


@query(
    "fold_fits",
    f"""with {MARKET}, t as (select ts, row_number() over (order by ts) - 1 as pos from (select distinct ts from mk)), k as (select unnest(range(0, 100)) as fold_id, (select count(*) from t) as n), fo as (select fold_id, a.ts as train_start, b.ts as train_end from k join t a on a.pos = fold_id * 48 join t b on b.pos = fold_id * 48 + 199 where fold_id * 48 + 248 <= n),
 i as (select fold_id, mk.*, row_number() over (partition by fold_id, asset order by ts desc) as rn from mk join fo on ts between train_start and train_end), f as (select fold_id, asset, regr_slope(log_return, factor) as b, regr_r2(log_return, factor) as r2 from i where rn <= 72 and log_return is not null and asset <> 'click' group by 1, 2 having count(*) >= 24)
 select cast(fold_id as integer) as fold_id, round(avg(b), 5) as mean_beta_factor, round(avg(r2), 5) as mean_r2, count(r2) as n_assets from f group by 1""",
)
def fold_fits(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.with_market(spark, sf)
    return rounded(factors.walk_forward_ols(p.where("asset <> 'click'"), backtest.walk_forward_folds(p, 200, 48, 48), ["factor"]), 5)


@query("clean_momentum", f"""with {WIDE}, m as (select asset, ts, case when count(log_return) over w = 1 then exp(sum(log_return) over w) - 1 end as y, liquidity_usd as x from wide window w as (partition by asset order by ts rows 0 preceding)), c as (select *, (y is not null and x is not null) as ok from m),
 s as (select *, count(case when ok then 1 end) over p as n, avg(case when ok then y end) over p as my, avg(case when ok then x end) over p as mx from c window p as (partition by ts)),
 b as (select *, sum(case when ok then (x - mx) * (y - my) end) over p as sxy, sum(case when ok then (x - mx) * (x - mx) end) over p as sxx from s window p as (partition by ts))
 select asset, ts, round(case when asset = 'u00001' then null when n < 3 then y when ok then y - my - (case when sxx > 1e-18 then sxy / sxx else 0 end) * (x - mx) end, 5) as value from b""")
def clean_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.clean_momentum(inputs.wide(spark, sf), "1D", ["liquidity_usd"], ["u00001"]).select("asset", "ts", "value"), 5)


@query("short_reversal", f"with {RET} select asset, ts, round(case when count(log_return) over w = 6 then -sum(log_return) over w end, 6) as value from ret window w as (partition by asset order by ts rows 5 preceding)")
def short_reversal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.short_reversal(inputs.returns(spark, sf), "1h").select("asset", "ts", "value"))


@query(
    "conditioned_low_vol",
    f"""with {RET}, d as (select ts, stddev_samp(log_return) as d from ret group by 1), z as (select ts, case when count(d) over w = 24 and stddev_samp(d) over w > 0 then (d - avg(d) over w) / stddev_samp(d) over w end as z from d window w as (order by ts rows 23 preceding)),
 g as (select ts, coalesce(last_value(z ignore nulls) over (order by ts), first_value(z ignore nulls) over (order by ts rows between current row and unbounded following)) as z from z), t as (select asset, ts, case when count(log_return) over w = 24 then -stddev_samp(log_return) over w end as v from ret window w as {_W24})
 select asset, ts, round(v * case when z >= 0 then 1.0 when z < 0 then -1.0 end, 6) as value from t join g using (ts)""",
)
def conditioned_low_vol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.low_vol_by_dispersion(inputs.returns(spark, sf), "1h").select("asset", "ts", "value"))


@query("shock_variants", f"with {BARS}, g as (select (select count(distinct ts) from bars) * (select count(distinct asset) from bars) as n) select 'N' || v.n || '_w' || v.p || '_c' || v.c as variant, g.n as n_rows from g cross join (select a.n, b.p, c.c from (values (6), (12), (24), (48)) a(n), (values ('0.01'), ('0.05')) b(p), (values (3), (5)) c(c)) v")
def shock_variants(spark: SparkSession, sf: str) -> DataFrame:
    return signals.liquidity_shock_variants(inputs.bars(spark, sf)).groupBy("variant").agg(F.count(F.lit(1)).alias("n_rows"))


# --- scans --------------------------------------------------------------------------------------


@query(
    "breakout_scan",
    f"""with {WIDE}, n as (select *, row_number() over (partition by asset order by ts desc) as rn from wide where log_return is not null), t as (select *, stddev_samp(log_return) over (partition by asset order by ts rows 9 preceding) as vol from n where rn <= 60), s as (select *, vol - lag(vol) over (partition by asset order by ts) as slope from t),
 m as (select asset, count(*) as n, arg_max(log_return, ts) as l, avg(log_return) as m, stddev_samp(log_return) as s, arg_max(slope, case when slope is not null then ts end) as sl, arg_max(close, ts) as close from s group by 1)
 select asset, round((l - m) / s, 6) as return_zscore, round(l, 6) as last_return, round(close, 6) as close from m where n >= 10 and s > 0 and (l - m) / s >= 0.5 and coalesce(sl, 0) > 0 order by (l - m) / s desc, asset limit 10""",
)
def breakout_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scan.volatility_breakout(inputs.wide(spark, sf), 10, 0.5, 10))


@query("vol_leaders", f"with {MARKET}, v as (select asset, stddev_samp(log_return) * sqrt(8760) as annual_vol from mk group by 1) select asset, round(annual_vol, 4) as annual_vol from v order by v.annual_vol desc nulls last, asset limit 3")
def vol_leaders(spark: SparkSession, sf: str) -> DataFrame:
    m = scan.trading_metrics(inputs.with_market(spark, sf), "1h")
    return rounded(scan.leaderboards(m, 3)["volatility"].select("asset", "annual_vol"), 4)


@query(
    "risk_snapshot",
    f"""with {MARKET}, e as (select *, exp(sum(log_return) over (partition by asset order by ts)) as eq, row_number() over (partition by asset order by ts desc) as rn from mk), d as (select *, eq / max(eq) over (partition by asset order by ts) - 1 as dd from e)
 select asset, round(exp(sum(case when rn <= 24 then log_return end)) - 1, 6) as return_24h, round(avg(log_return) / stddev_samp(log_return) * sqrt(8760), 4) as annual_sharpe, round(min(dd), 6) as max_drawdown, count(*) as n_bars from d group by 1""",
)
def risk_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    m = scan.trading_metrics(inputs.with_market(spark, sf), "1h")
    return m.select("asset", F.round("return_24h", 6).alias("return_24h"), F.round("annual_sharpe", 4).alias("annual_sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"), "n_bars")


# --- regimes ------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    f = regimes.features(inputs.returns(spark, sf))
    return regimes.predict(f, regimes.fit_detector(f)).select("ts", "regime")


_ICH = _MOM3 + f""", fh as (select asset, ts, h.h as horizon, case when h.h = 1 then case when count(log_return) over a = 1 then exp(sum(log_return) over a) - 1 end else case when count(log_return) over b = 2 then exp(sum(log_return) over b) - 1 end end as fwd from o cross join (values (1), (2)) h(h) window a as (partition by h.h, asset order by ts rows between 1 following and 1 following), b as (partition by h.h, asset order by ts rows between 1 following and 2 following)),
 c0 as (select horizon, ts, value as s, fwd as f from sig join fh using (asset, ts) where value is not null and fwd is not null), c1 as (select horizon, ts, {_RANK.format(x='s', p='horizon, ts')} as s, {_RANK.format(x='f', p='horizon, ts')} as f from c0), ich as (select horizon, ts, {CORR.format(x='s', y='f', w='')} as ic from c1 group by 1, 2)"""


@query("decay_by_regime", f"""with {_ICH}, j as (select *, case when day(ts) % 2 = 0 then 'even' else 'odd' end as regime from ich)
 select regime, horizon as horizon_bars, round(case when count(ic) >= 2 then avg(ic) end, 6) as mean_ic, round(case when count(ic) >= 2 then stddev_samp(ic) end, 6) as std_ic, count(ic) as n_obs from j group by 1, 2""")
def decay_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    s, w = _momentum3(spark, sf)
    ic = cross_section.ic_by_horizon(s, w, [1, 2])
    labels = w.select("ts").distinct().withColumn("regime", F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd"))
    return rounded(regimes.decay_by_regime(ic, labels).select("regime", "horizon_bars", "mean_ic", "std_ic", "n_obs"))


@query("ic_by_regime", f"with {_IC}, j as (select *, case when day(ts) % 2 = 0 then 'even' else 'odd' end as regime from ic) select regime, round(avg(ic), 6) as mean_ic, round(stddev_samp(ic), 6) as std_ic, count(ic) as n_obs from j group by 1 having count(ic) >= 2")
def ic_by_regime(spark: SparkSession, sf: str) -> DataFrame:
    s, w = _momentum3(spark, sf)
    ic = cross_section.information_coefficient(s, returns.forward_return(w, 2))
    labels = w.select("ts").distinct().withColumn("regime", F.when(F.dayofmonth("ts") % 2 == 0, "even").otherwise("odd"))
    return rounded(regimes.ic_by_regime(ic, labels).where("n_obs >= 2").select("regime", "mean_ic", "std_ic", "n_obs"))


@query("regime_coverage", f"with {_REG} select count(*) as n, 0 as n_unknown, 1.0 as pct_available, '{{' || string_agg('\"' || regime || '\":' || c, ',' order by regime) || '}}' as distribution from (select regime, c, unnest(range(c)) from (select regime, count(*) as c from rg group by 1)) group by all having false union all select sum(c)::bigint, 0, 1.0, '{{' || string_agg('\"' || regime || '\":' || c, ',' order by regime) || '}}' from (select regime, count(*) as c from rg group by 1)")
def regime_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.coverage(_labels(spark, sf)).withColumn("n_unknown", F.col("n_unknown").cast("int"))


@query("regime_means", f"with {_REG}, p as (select ts, avg(log_return) as pnl from ret where log_return is not null group by 1) select regime, count(*) as n, round(avg(pnl), 6) as mean_pnl from p join rg using (ts) group by 1")
def regime_means(spark: SparkSession, sf: str) -> DataFrame:
    pnl = inputs.returns(spark, sf).where("log_return is not null").groupBy("ts").agg(F.avg("log_return").alias("pnl"))
    return rounded(cross_section.means_by(pnl.join(_labels(spark, sf), "ts").drop("ts")))


@query("regime_percentiles", f"with {RET}, r as (select asset, ts, close, ({_RANK.format(x='close', p='asset')}) / count(close) over (partition by asset) as r from bars) select asset, ts, case when r < 0.33 then 'Low' when r <= 0.66 then 'Mid' when r is not null then 'High' end as regime from r")
def regime_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.from_percentile(inputs.bars(spark, sf), "close").select("asset", "ts", "regime")


# --- backtests and inference --------------------------------------------------------------------


@query(
    "trend_positions",
    f"""with recursive {BARS}, n as (select asset, ts, close, liquidity_usd, row_number() over (partition by asset order by ts) as i, count(*) over (partition by asset) as c from bars),
 e(asset, i, ts, close, liq, f, s) as (select asset, i, ts, close, liquidity_usd, close, close from n where i = 1 and c >= 55 union all select n.asset, n.i, n.ts, n.close, n.liquidity_usd, e.f + (2.0 / 21) * (n.close - e.f), e.s + (2.0 / 51) * (n.close - e.s) from e join n on n.asset = e.asset and n.i = e.i + 1),
 p as (select *, case when f > s then 0.25 else 0.0 end as position, ln(close) - lag(ln(close)) over (partition by asset order by ts) as r from e), b as (select *, coalesce(lag(position) over (partition by asset order by ts), 0.0) as before from p),
 c as (select *, coalesce(before * r - abs(position - before) * (30 + case when liq > 0 then least(50, 10 * sqrt(1000000 / liq)) else 50 end) / 10000, 0) as net from b)
 select asset, ts, position, round(net, 6) as net, round(exp(sum(case when net > -1 then ln(1 + net) end) over (partition by asset order by ts)), 5) as equity, case when position > before then 'long' when position < before then 'exit' end as trade from c""",
)
def trend_positions(spark: SparkSession, sf: str) -> DataFrame:
    t = backtest.trend_strategy(inputs.bars(spark, sf), liquidity="liquidity_usd", slippage_bps=None)
    return t.select("asset", "ts", "position", F.round("net", 6).alias("net"), F.round("equity", 5).alias("equity"), "trade")


@query("fold_parts", f"with {BARS}, t as (select ts, row_number() over (order by ts) - 1 as pos from (select distinct ts from bars)), k as (select unnest(range(0, 100)) as fold_id, (select count(*) from t) as n), p as (select fold_id, pos, case when pos between fold_id * 48 and fold_id * 48 + 199 then 'train' when pos between fold_id * 48 + 205 and fold_id * 48 + 252 then 'test' end as part, ts from k, t where fold_id * 48 + 253 <= n) select cast(fold_id as integer) as fold_id, part, count(*) as n_rows from p join bars using (ts) where part is not null group by 1, 2")
def fold_parts(spark: SparkSession, sf: str) -> DataFrame:
    b = inputs.bars(spark, sf)
    return backtest.by_fold(b, backtest.walk_forward_folds(b, 200, 48, 48, purge=2, embargo=3)).groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n_rows"))


@query("cost_drag", f"with {RET}, s as (select avg(log_return) as pnl from ret where log_return is not null group by ts), g as (select exp(sum(ln(1 + pnl / 100))) - 1 as g, exp(sum(ln(1 + pnl / 100 - 0.0001))) - 1 as n from s) select round(g, 6) as gross_return, round(n, 6) as net_return, round(g - n, 6) as drag from g")
def cost_drag(spark: SparkSession, sf: str) -> DataFrame:
    s = inputs.returns(spark, sf).where("log_return is not null").groupBy("ts").agg((F.avg("log_return") / 100).alias("pnl"))
    return rounded(backtest.cost_sensitivity(s.withColumn("net", F.col("pnl") - 0.0001)).drop("drag_pct"))


@query("overfit_proxy", "with f as (select o_orderkey, o_totalprice % 97 as t from orders) select round(avg((t < m)::int::double), 6) as pbo_proxy, count(*) as n_folds from (select t, (select median(t) from f) as m from f)")
def overfit_proxy(spark: SparkSession, sf: str) -> DataFrame:
    o = inputs.table(spark, sf, "orders").select(F.lit(1.0).alias("train_sharpe"), (F.col("o_totalprice") % 97).alias("test_sharpe"))
    return rounded(inference.pbo_proxy(o))


@query("rejections", "with p as (select (abs(c_acctbal) % 1000) / 1000.0 as p from customer) select round(avg((p < 0.05)::int::double), 6) as rejection_rate, count(*) as n_trials from p")
def rejections(spark: SparkSession, sf: str) -> DataFrame:
    c = inputs.table(spark, sf, "customer").select(((F.abs("c_acctbal") % 1000) / 1000.0).alias("p_value"))
    return rounded(inference.type_one_error(c).select("rejection_rate", "n_trials"))


@query("false_discoveries", "with t as (select c_custkey % 7 as d, least(c_custkey % 3, c_custkey % 7) as t from customer) select round(avg(case when d > 0 then (d - t) / d::double else 0 end), 6) as fdr from t")
def false_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return rounded(inference.false_discovery(inputs.table(spark, sf, "customer").select((k % 7).alias("n_discoveries"), F.least(k % 3, k % 7).alias("n_true"))))


# --- registry, universe, governance -------------------------------------------------------------


@query("found_experiments", "select 'r' || o_orderkey as run_id from orders where o_orderpriority = '1-URGENT' and o_comment_like = 1 order by o_orderdate desc, run_id limit 20".replace("o_comment_like = 1", "lower('r' || o_orderkey || ' h ' || o_orderstatus) like '%h f%'"))
def found_experiments(spark: SparkSession, sf: str) -> DataFrame:
    o = inputs.table(spark, sf, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("H "), F.col("o_orderstatus")).alias("hypothesis"), F.lit(None).cast("string").alias("notes"), F.lit("{}").alias("params_json"), F.to_json(F.array("o_orderpriority")).alias("tags_json"))
    return governance.experiments(o, "1-URGENT", "h f", 20).select("run_id")


@query("journal_tail", "select event_id, event_type as signal from events where event_type = 'click' order by ts desc limit 25")
def journal_tail(spark: SparkSession, sf: str) -> DataFrame:
    return governance.recent(inputs.table(spark, sf, "events").withColumnRenamed("event_type", "signal"), "click", 25).select("event_id", "signal")


@query("metric_names", "select distinct l_returnflag as metric_name from lineitem")
def metric_names(spark: SparkSession, sf: str) -> DataFrame:
    return governance.metric_names(inputs.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "metric_name"))


@query("run_metrics", "select l_linenumber as metric_name, round(l_extendedprice, 4) as metric_value from lineitem where l_orderkey = 1")
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("metric_name"), F.col("l_extendedprice").alias("metric_value"))
    return rounded(governance.run_metrics(m, 1), 4)


_CAND = "cd as (select 'c' || o_orderkey as candidate_id, case o_orderkey % 4 when 0 then 'accepted' when 1 then 'candidate' else 'exploratory' end as status, 'r' || o_custkey as run_id, o_orderdate as created_at from orders), rp as (select 'c' || o_orderkey as candidate_id, 'e' || o_orderkey as eligibility_report_id, case when o_orderkey % 3 = 0 then 'candidate' else 'accepted' end as level, o_orderkey % 5 > 0 as passed from orders)"


def _registry(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, k = inputs.table(spark, sf, "orders"), F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    status = F.when(k % 4 == 0, "accepted").when(k % 4 == 1, "candidate").otherwise("exploratory")
    c = o.select(name("c", "o_orderkey").alias("candidate_id"), status.alias("status"), name("r", "o_custkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    r = o.select(name("c", "o_orderkey").alias("candidate_id"), name("e", "o_orderkey").alias("eligibility_report_id"), F.when(k % 3 == 0, "candidate").otherwise("accepted").alias("level"), (k % 5 > 0).alias("passed"))
    return c, r


@query("listed_candidates", f"with {_CAND} select candidate_id from cd where status = 'accepted' order by created_at desc, candidate_id limit 30")
def listed_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return governance.candidates(_registry(spark, sf)[0], "accepted", limit=30).select("candidate_id")


@query("unsupported_candidates", f"with {_CAND} select candidate_id from cd where status in ('candidate', 'accepted') and not exists (select 1 from rp where passed and rp.candidate_id = cd.candidate_id and level = status)")
def unsupported_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return governance.unsupported(*_registry(spark, sf))


@query("promoted_candidates", f"with {_CAND} select cd.candidate_id, case when passed and level = 'accepted' then 'accepted' else status end as status from cd join rp using (candidate_id)")
def promoted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return governance.promote(*_registry(spark, sf), "accepted")[0].select("candidate_id", "status")


@query("promotion_events", f"with {_CAND} select candidate_id, 'promoted' as event_type from rp where passed and level = 'accepted'")
def promotion_events(spark: SparkSession, sf: str) -> DataFrame:
    return governance.promote(*_registry(spark, sf), "accepted")[1].select("candidate_id", "event_type")


@query("eligible_bundles", "select 'b' || o_orderkey as id, cast((o_orderkey % 2 = 0)::int + (o_custkey % 3 = 0)::int + (o_custkey % 5 = 0)::int + (o_custkey % 5 = 0 or o_custkey % 4 = 0)::int as integer) as n_blockers from orders")
def eligible_bundles(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    there = F.lit("x")
    b = inputs.table(spark, sf, "orders").select(F.concat(F.lit("b"), k.cast("string")).alias("id"), F.when(k % 2 > 0, there).alias("run_key"), F.when(c % 3 == 0, " ").otherwise("d").alias("dataset_id"), there.alias("engine_version"), there.alias("config_version"), there.alias("seed_version"), F.when(c % 5 > 0, F.when(c % 4 == 0, 0.5).otherwise(0.01)).alias("rc_p_value"))
    return governance.eligibility(b, "accepted").select("id", F.size("blockers").alias("n_blockers"))


@query("audit_gaps", f"with {_CAND} select candidate_id, cast((not passed)::int + (cast(substr(run_id, 2) as integer) % 2 = 0)::int as integer) as n_lacks from cd join rp using (candidate_id) where status = 'accepted' and (not passed or cast(substr(run_id, 2) as integer) % 2 = 0)")
def audit_gaps(spark: SparkSession, sf: str) -> DataFrame:
    c, r = _registry(spark, sf)
    events = c.select("candidate_id", F.lit("promoted").alias("event_type"))
    lineage = c.select(F.col("run_id").alias("run_instance_id"), F.lit("a").alias("artifact_id")).where(F.substring("run_id", 2, 20).cast("int") % 2 > 0)
    return governance.unauditable(c, r, events, lineage).select("candidate_id", F.size("lacks").alias("n_lacks"))


@query("acceptance_trace", f"with {_CAND} select candidate_id, 'report' as kind, eligibility_report_id as id from rp union all select candidate_id, 'event', 'made' from cd union all select candidate_id, 'artifact', 'a' || run_id from cd")
def acceptance_trace(spark: SparkSession, sf: str) -> DataFrame:
    c, r = _registry(spark, sf)
    lineage = c.select(F.col("run_id").alias("run_instance_id"), F.concat(F.lit("a"), "run_id").alias("artifact_id")).distinct()
    return governance.trace(c, r, c.select("candidate_id", F.lit("made").alias("event_type")), lineage)


@query("candidate_events", "select 'e' || l_linenumber as event_type from lineitem where l_orderkey = 1")
def candidate_events(spark: SparkSession, sf: str) -> DataFrame:
    e = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("candidate_id"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("event_type"), F.col("l_shipdate").alias("created_at"))
    return governance.events_of(e, "1").select("event_type")


@query("new_candidates", "select 'd' as dataset_id, o_custkey as run_id, o_orderstatus as signal_name, substr(sha256('d|' || o_custkey || '|' || o_orderstatus || '|1|'), 1, 16) as candidate_id, 'exploratory' as status from (select distinct o_custkey, o_orderstatus from orders)")
def new_candidates(spark: SparkSession, sf: str) -> DataFrame:
    o = inputs.table(spark, sf, "orders").select(F.lit("d").alias("dataset_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("signal_name"), F.lit(1).alias("horizon"), F.lit(None).cast("string").alias("config_hash"))
    return governance.new_candidates(o).select("dataset_id", "run_id", "signal_name", "candidate_id", "status")


@query("backfilled_ids", "select o_orderkey as id, case when o_orderkey % 3 = 0 or o_orderkey % 4 = 0 then 'new' else 'old' end as dataset_id from orders")
def backfilled_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = inputs.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 == 0, None).when(k % 4 == 0, " ").otherwise("old").alias("dataset_id"))
    return governance.backfilled(o, "new")


@query("universe_actions", f"with {_ALLOW}, l as (select ts, case when liquidity_usd > 100000 then 'add' else 'remove' end as action, source as reason from al) select action, reason, count(*) as n from l where ts = (select max(ts) from l) group by 1, 2")
def universe_actions(spark: SparkSession, sf: str) -> DataFrame:
    a = _allowlist(spark, sf)
    log = a.select("ts", "pair_address", F.when(F.col("liquidity_usd") > 100_000, "add").otherwise("remove").alias("action"), F.col("source").alias("reason"))
    return universe.churn_verification(a, log)[1].select("action", "reason", "n")


@query("tick_messages", f"with {TICKS} select asset, ts, event_id, round(price, 6) as price, round(size, 6) as size from ticks")
def tick_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's parser over the same rows as a batch; a test runs the stream."""
    from tidemark.streaming.ticks import from_messages

    e = inputs.table(spark, sf, "events")
    body = F.concat(F.lit('{"channel":"market_trades","events":[{"type":"update","trades":[{"product_id":"'), "event_type", F.lit('","trade_id":"'), F.col("event_id").cast("string"), F.lit('","price":"'), F.col("value").cast("string"), F.lit('","size":"'), F.col("value").cast("string"), F.lit('","time":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"}]}]}'))
    return rounded(from_messages(e.select(body.alias("value"))).select("asset", "ts", F.col("event_id").cast("long").alias("event_id"), "price", "size"))

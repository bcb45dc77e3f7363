"""Frequencies, thresholds and scalar classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Periods of a year, rolling windows and filters by frequency.
PERIODS_PER_YEAR = {"5min": 105_120, "15min": 35_040, "1h": 8_760, "1D": 365}
SHORT_LONG = {"1h": (24, 72), "5min": (288, 864), "15min": (96, 288), "1D": (7, 21)}
VOL_WINDOW = {"1h": 24, "5min": 288, "15min": 96, "1D": 7}
MIN_LIQUIDITY, MIN_VOLUME, MIN_BARS = 250_000.0, 500_000.0, 48
STABLES = ("USDC", "USDT", "DAI", "BUSD", "TUSD", "USDP", "FRAX")
BITCOINS = ("BTC", "WBTC", "CBBTC")


def normalize_freq(freq: str) -> str:
    """The canonical name of a frequency: 1H, 60min and hour are 1h, 1d and day are 1D."""
    f = freq.strip().lower()
    if f in ("1h", "h", "60min", "hour", "hourly"):
        return "1h"
    if f in ("1d", "d", "day", "daily", "24h"):
        return "1D"
    m = re.fullmatch(r"(\d+)\s*(?:min|m|t)", f)
    return ("5min" if int(m[1]) <= 5 else f"{int(m[1])}min") if m else freq


def minutes(freq: str) -> int:
    f = normalize_freq(freq)
    m = re.fullmatch(r"(\d+)(min|h|D)", f)
    if not m:
        raise ValueError(f"unknown frequency: {freq}")
    return int(m[1]) * {"min": 1, "h": 60, "D": 1440}[m[2]]


def periods_per_year(freq: str) -> float:
    f = normalize_freq(freq)
    return float(PERIODS_PER_YEAR.get(f) or 365.25 * 1440 / minutes(f))


def bars_per_day(freq: str) -> int:
    return max(1, 1440 // minutes(freq))


def bars_for_hours(freq: str, hours: float) -> int:
    return max(1, int(hours * 60 // minutes(freq)))


def period_return_bars(freq: str) -> dict[str, int]:
    return {name: bars_for_hours(freq, h) for name, h in (("1h", 1), ("24h", 24), ("1d", 24), ("3d", 72))}


def rolling_windows(freq: str) -> tuple[int, int]:
    return SHORT_LONG.get(normalize_freq(freq), (24, 72))


def dispersion_window(freq: str) -> int:
    return rolling_windows(freq)[1]


def annualize_sharpe(sharpe: Column, freq: str) -> Column:
    return sharpe * F.lit(periods_per_year(freq) ** 0.5)


def interval(freq: str) -> str:
    return f"{minutes(freq)} minutes"


def beta_state(short: Column, long: Column, threshold: float = 0.15) -> Column:
    """compressed when the short beta is below the long one by the threshold, expanded when above."""
    d = short - long
    return F.when(d.isNull(), "unknown").when(d < -threshold, "compressed").when(d > threshold, "expanded").otherwise("stable")


def vol_regime(short: Column, medium: Column, rising: float = 1.25, falling: float = 0.75) -> Column:
    r = F.try_divide(short, medium)
    return F.when(r.isNull() | (medium <= 0), "unknown").when(r >= rising, "rising").when(r <= falling, "falling").otherwise("stable")


def market_regime(dispersion_z: Column, vol: Column, beta: Column) -> Column:
    """One label from the dispersion z-score and two states; the first rule that holds decides.

    Rising volatility with a compressed beta or low dispersion is risk_off; then dispersion beyond
    one deviation decides; then two stable states are chop; then the sign of the dispersion decides.
    """
    v, b = F.lower(F.trim(F.coalesce(vol, F.lit("")))), F.lower(F.trim(F.coalesce(beta, F.lit(""))))
    low, high = F.coalesce(dispersion_z < -1, F.lit(False)), F.coalesce(dispersion_z > 1, F.lit(False))
    return (
        F.when((v == "rising") & ((b == "compressed") | low), "risk_off")
        .when(low, "macro_beta")
        .when(high, "dispersion")
        .when((v == "stable") & (b == "stable"), "chop")
        .when(dispersion_z <= 0, "macro_beta")
        .when(dispersion_z > 0, "dispersion")
        .otherwise("chop")
    )


#: What each market regime means.
REGIME_TEXT = {
    "macro_beta": "Assets move together with the market factor.",
    "dispersion": "Assets move apart; relative value matters.",
    "risk_off": "Volatility rises while assets move together.",
    "chop": "Volatility and betas are stable; prices move within a range.",
}


def explain_regime(regime: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in REGIME_TEXT.items() for x in kv])
    return F.coalesce(pairs[regime], F.lit("The inputs give no regime."))


def slippage_bps(liquidity: Column, scale: float = 10.0, at: float = 1e6, most: float = 50.0) -> Column:
    """min(50, 10 * sqrt(1e6 / liquidity)); the most where liquidity is missing or not positive."""
    return F.when(liquidity > 0, F.least(F.lit(most), F.lit(scale) * F.sqrt(F.lit(at) / liquidity))).otherwise(F.lit(most))


def spread_bps(vol: Column, liquidity: Column, base: float = 10.0, vol_scale: float = 50.0) -> Column:
    v = F.greatest(F.coalesce(vol, F.lit(0.0)), F.lit(0.0))
    liq = F.greatest(F.coalesce(liquidity, F.lit(0.0)), F.lit(0.0))
    return F.lit(base) + v * vol_scale + F.least(F.lit(50.0), F.lit(1e6) / (liq + 1e4))


def impact_bps(participation_pct: Column, per_pct: float = 5.0, most_pct: float = 10.0) -> Column:
    return F.when(participation_pct > 0, F.least(participation_pct, F.lit(most_pct)) * per_pct).otherwise(F.lit(0.0))


def is_stable_pair(base: Column, quote: Column) -> Column:
    inside = lambda c: F.upper(F.trim(c)).isin(*STABLES)
    return F.coalesce(inside(base) & inside(quote), F.lit(False))


def is_btc_pair(label: Column) -> Column:
    parts = F.split(F.upper(label), r"[/\s]+")
    return F.coalesce(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in BITCOINS])), F.lit(False))


def parse_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def to_float(text: Column) -> Column:
    return text.try_cast("double")


def pair_parts(pair: Column) -> tuple[Column, Column]:
    """chain and address of "chain:address"."""
    return F.substring_index(pair, ":", 1), F.regexp_extract(pair, r"^[^:]*:(.*)$", 1)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the error-function series of Abramowitz and Stegun
    7.1.26 (absolute error below 1.5e-7), in plain expressions."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)

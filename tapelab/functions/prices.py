"""Price, quote and return expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000
INF = float("inf")


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite (NaN sorts above infinity in Spark)."""
    return x.isNotNull() & (x < F.lit(INF)) & (x > F.lit(-INF))


def positive(x: Column) -> Column:
    return finite(x) & (x > 0)


def unit(x: Column) -> Column:
    return finite(x) & (x >= 0) & (x <= 1)


def yes_price(price: Column, label: Column) -> dict[str, Column]:
    """Price of the YES side and whether the label allowed normalising it."""
    side = F.lower(F.trim(label))
    yes, no = side.isin("yes", "up"), side.isin("no", "down")
    return {
        "yes_price": F.when(no, 1.0 - price).otherwise(price),
        "yes_normalized": F.coalesce(yes | no, F.lit(False)),
    }


def complement(df: DataFrame) -> DataFrame:
    """YES quotes from NO tops; rejected rows keep null quotes and a reason."""
    bid, ask = F.col("no_bid"), F.col("no_ask")
    sizes = [F.col("no_bid_size"), F.col("no_ask_size")]
    in_range = unit(bid) & unit(ask)
    for s in sizes:
        in_range = in_range & finite(s) & (s >= 0)
    reason = F.when(~in_range, "range").when(bid > ask, "bad_spread")
    ok = F.col("reject_reason").isNull()
    return df.withColumn("reject_reason", reason).withColumns(
        {
            "yes_bid": F.when(ok, 1.0 - ask),
            "yes_ask": F.when(ok, 1.0 - bid),
            "yes_bid_size": F.when(ok, sizes[1]),
            "yes_ask_size": F.when(ok, sizes[0]),
            "yes_mid": F.when(ok, 1.0 - (bid + ask) / 2.0),
            "fidelity": F.lit("SYNTHETIC_COMPLEMENT"),
            "source": F.lit("SYNTHETIC_COMPLEMENT"),
        }
    )


def to_micros(price: Column) -> Column:
    """Fixed-point price in 1e-6 units, rounded half away from zero."""
    return F.round(price * MICROS).cast("long")


def from_micros(micros: Column) -> Column:
    return micros / F.lit(float(MICROS))


def is_tick_multiple(price: Column, tick: Column) -> Column:
    t = to_micros(tick)
    return F.when(t > 0, F.pmod(to_micros(price), t) == 0).otherwise(F.lit(False))


def candidate_micros(bid_micros: Column, ask_micros: Column, tick_micros: Column) -> Column:
    """Post-only price one tick over the bid, rounded up to the grid, in micros.

    Null when the tick is not positive, the price would pass 1, or it reaches the ask.
    """
    up = F.ceil((bid_micros + tick_micros) / tick_micros).cast("long") * tick_micros
    ok = (tick_micros > 0) & (up <= MICROS) & (up < ask_micros)
    return F.when(ok, up)


def valid_quote(df: DataFrame, bid="yes_bid", ask="yes_ask", mid: str | None = None) -> DataFrame:
    """``quote_ok`` and ``quote_mid`` (the given mid when finite, else the average)."""
    b, a = F.col(bid), F.col(ask)
    given = F.col(mid) if mid else F.lit(None).cast("double")
    m = F.when(finite(given), given).otherwise((b + a) / 2.0)
    ok = unit(b) & unit(a) & unit(m)
    return df.withColumns({"quote_ok": ok, "quote_mid": F.when(ok, m)})


def first_available(a: Column, b: Column) -> Column:
    """The first value unless it is null or NaN."""
    return F.coalesce(F.when(~F.isnan(a), a), F.when(~F.isnan(b), b))


def spread_mid(bid: Column, ask: Column) -> dict[str, Column]:
    return {"spread": ask - bid, "mid": (bid + ask) / 2.0}


def pct_return(old: Column, new: Column) -> Column:
    """Simple return in percent, null unless both prices are positive and finite."""
    return F.when(positive(old) & positive(new), (new / old - 1.0) * 100.0)


def rel_diff(value: Column, reference: Column) -> Column:
    """Percent difference; 0.0 when either price is unusable."""
    return F.coalesce(pct_return(reference, value), F.lit(0.0))


def distance_to_target(spot: Column, target: Column, kind: Column) -> Column:
    """Percent distance, positive when it favours YES."""
    d = rel_diff(spot, target)
    return F.when(kind == "BELOW", -d).otherwise(d)


def resolves_yes(spot: Column, target: Column, kind: Column) -> Column:
    ok = positive(spot) & positive(target)
    hit = F.when(kind == "BELOW", spot <= target).otherwise(spot >= target)
    return F.when(ok, hit).otherwise(F.lit(False))


def sigma_distance(pct: Column, sigma_pct: Column, secs: Column, scaled: bool = True) -> Column:
    """Distance in standard deviations, scaled by the square root of the time left."""
    usable = finite(pct) & positive(sigma_pct)
    if scaled:
        usable = usable & (secs > 0)
        value = pct / (sigma_pct * F.sqrt(secs.cast("double")))
    else:
        value = pct / sigma_pct
    return F.when(usable, F.when(finite(value), value)).otherwise(F.lit(0.0))


def valid_candle(df: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    priced = positive(o) & positive(h) & positive(low) & positive(c)
    reason = (
        F.when(~F.coalesce(priced, F.lit(False)), "not_positive")
        .when(h < low, "high_below_low")
        .when(h < F.greatest(o, c), "high_below_body")
        .when(low > F.least(o, c), "low_above_body")
    )
    return df.withColumn("candle_reject", reason)


def aggressor(side: Column) -> Column:
    s = F.upper(F.trim(side))
    return F.when(s.isin("BUY", "SELL"), s).otherwise(F.lit("UNKNOWN"))


def invert_aggressor(side: Column) -> Column:
    s = aggressor(side)
    return F.when(s == "BUY", "SELL").when(s == "SELL", "BUY").otherwise(s)

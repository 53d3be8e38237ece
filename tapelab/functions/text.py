"""Market text: classification, strikes, windows, sources, fidelity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of the market horizons in free text.
HORIZON_WORDS = {
    "5m": ("5m", "5min", "5mins", "5minute", "5minutes"),
    "15m": ("15m", "15min", "15mins", "15minute", "15minutes"),
    "1h": ("1h", "1hr", "1hour", "1hours"),
    "4h": ("4h", "4hr", "4hour", "4hours"),
}
# Durations the horizons stand for, in seconds.
HORIZON_TARGETS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400}
# Venues named as resolution sources.
VENUES = ("chainlink", "binance", "coinbase")
# Words that point at a strike.
OPERATOR_WORDS = (
    "above", "below", "over", "under", "greater", "less", "reach", "hit", "at least",
    "higher", "lower",
)
# An asset named by itself.
LONE = {
    "BTC": r"(?i)(?<![a-z0-9])(?:btc|bitcoin)(?![a-z0-9])",
    "ETH": r"(?i)(?<![a-z0-9])(?:eth|ethereum)(?![a-z0-9])",
}
# Number units.
UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9}
# A number with optional currency sign and unit.
NUMBER = (
    r"(?i)([$€£])?\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*"
    r"(k|thousand|m|million|b|billion)?\b"
)
# A wall-clock window such as "April 28, 1:00PM-1:15PM ET".
WINDOW = (
    r"([A-Za-z]+)\s+(\d{1,2}),\s*(\d{1,2}):(\d{2})(AM|PM)-(\d{1,2}):(\d{2})(AM|PM)"
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)


def _token_pattern(inner: str) -> str:
    """The inner pattern between token borders; it is tried only where a horizon's first character stands."""
    first = "".join(sorted({w[0] for ws in HORIZON_WORDS.values() for w in ws}))
    return f"(?=[{first}])(?<![a-z0-9])(?:{inner})(?![a-z0-9])"


def _pair_pattern() -> str:
    """Two neighbouring tokens that make a horizon word when joined, for every cut of every word."""
    rest: dict[str, list[str]] = {}
    for w in [w for ws in HORIZON_WORDS.values() for w in ws]:
        for i in range(1, len(w)):
            rest.setdefault(w[:i], []).append(w[i:])
    return _token_pattern("|".join(f"{head}[^a-z0-9]++(?:{'|'.join(tails)})" for head, tails in rest.items()))


HORIZON_TOKEN = _token_pattern("|".join(w for ws in HORIZON_WORDS.values() for w in ws))
HORIZON_PAIR = _pair_pattern()


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def first_text(*names: str) -> dict[str, Column]:
    """First non-blank of several fields and the name of the field that gave it."""
    text = field = F.lit(None).cast("string")
    for name in reversed(names):
        use = ~blank(F.col(name))
        text = F.when(use, F.col(name).cast("string")).otherwise(text)
        field = F.when(use, F.lit(name)).otherwise(field)
    return {"text": text, "field": field}


def _blob(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts]))


def guess_asset(*texts: Column) -> Column:
    blob = _blob(*texts)
    btc = blob.contains("btc") | blob.contains("bitcoin")
    eth = blob.contains("eth") | blob.contains("ethereum")
    return F.when(btc & ~eth, "BTC").when(eth & ~btc, "ETH").otherwise("")


def guess_kind(*texts: Column) -> Column:
    blob = _blob(*texts)
    updown = blob.contains("up or down") | blob.contains("updown") | blob.contains("up-down")
    below = blob.contains("below") | blob.contains("under") | blob.contains("less than")
    return F.when(updown, "UPDOWN").when(below, "BELOW").otherwise("ABOVE")


def _first_horizon(blob: Column, pattern: str) -> Column:
    """Horizon of the first place where the pattern fits; what separates two tokens is left out."""
    words = F.create_map(*[F.lit(x) for h, ws in HORIZON_WORDS.items() for w in ws for x in (w, h)])
    return words[F.regexp_replace(F.regexp_extract(blob, pattern, 0), "[^a-z0-9]+", "")]


def guess_horizon(*texts: Column, duration_s: Column | None = None) -> Column:
    """Single tokens first, then joined neighbours, then the duration within 5%.

    Both are sought in the text as it is, so no list of a long text's tokens is built.
    """
    blob = _blob(*texts)
    out = F.coalesce(_first_horizon(blob, HORIZON_TOKEN), _first_horizon(blob, HORIZON_PAIR))
    if duration_s is not None:
        for name, secs in HORIZON_TARGETS.items():
            near = F.abs(duration_s - secs) / secs < 0.05
            out = F.coalesce(out, F.when(near, F.lit(name)))
    return F.coalesce(out, F.lit(""))


def extract_strike(df: DataFrame, question: str, rules: str, asset: str | None = None) -> DataFrame:
    """Adds ``reference`` and ``strike``: the best-scored number, earliest on ties.

    Match offsets come from cutting the text at every match with the pieces' lengths
    summed; each candidate sees 40 characters on either side.
    """
    text = F.trim(F.concat_ws(" ", F.trim(F.coalesce(question_col(question), F.lit(""))),
                              F.trim(F.coalesce(question_col(rules), F.lit("")))))
    given = F.upper(F.trim(F.coalesce(F.col(asset), F.lit("")))) if asset else F.lit("")
    named = F.when(text.rlike(LONE["BTC"]), "BTC").when(text.rlike(LONE["ETH"]), "ETH")
    work = df.withColumn("_text", text).withColumn("_named", named)
    whole = F.regexp_extract_all("_text", F.lit(NUMBER), F.lit(0))
    parts = F.split(F.col("_text"), NUMBER, -1)
    work = work.withColumns({"_m": whole, "_parts": parts})
    # Start of match i = characters of pieces 0..i plus matches 0..i-1.
    starts = F.transform(
        F.col("_m"),
        lambda m, i: F.aggregate(
            F.zip_with(F.slice("_parts", 1, i + 1), F.slice(F.concat(F.array(F.lit("")), F.col("_m")), 1, i + 1),
                       lambda p, q: F.length(p) + F.length(q)),
            F.lit(0), lambda acc, x: acc + x,
        ),
    )
    work = work.withColumn("_at", starts)
    ops = r"(?i)\b(?:" + "|".join(OPERATOR_WORDS) + r")\b"

    def scored(m: Column, at: Column) -> Column:
        raw = F.regexp_extract(m, NUMBER, 2)
        unit = F.lower(F.regexp_extract(m, NUMBER, 3))
        currency = F.regexp_extract(m, NUMBER, 1) != ""
        grouped = raw.contains(",")
        factor = F.lit(1.0)
        for name, x in UNITS.items():
            factor = F.when(unit == name, F.lit(x)).otherwise(factor)
        value = F.regexp_replace(raw, ",", "").try_cast("double") * factor
        lo = F.greatest(F.lit(0), at - 40)
        window = F.substring(F.col("_text"), lo + 1, at + F.length(m) + 40 - lo)
        has_op = window.rlike(ops)
        near = F.when(F.col("_named") == "BTC", window.rlike(LONE["BTC"])).when(
            F.col("_named") == "ETH", window.rlike(LONE["ETH"])
        )
        keep = (
            (value > 0)
            & (currency | grouped | (unit != "") | ((value >= 100) & has_op))
            & ~(unit.isin("m", "million") & (value < 100_000))
        )
        score = (
            F.when(currency, 4).otherwise(0)
            + F.when(grouped, 3).otherwise(0)
            + F.when(unit != "", 2).otherwise(0)
            + F.when(has_op, 1).otherwise(0)
            + F.when(near, 2).otherwise(0)
        )
        return F.when(keep, F.struct(score.alias("score"), (-at).alias("pos"), value.alias("value")))

    best = F.array_max(F.filter(F.zip_with("_m", "_at", scored), lambda x: x.isNotNull()))
    return work.withColumns(
        {"strike": best.getField("value"), "reference": F.coalesce(F.col("_named"), given)}
    ).drop("_text", "_named", "_m", "_parts", "_at")


def question_col(name: str) -> Column:
    return F.col(name).cast("string")


def parse_window(question: Column, year: Column) -> dict[str, Column]:
    """UTC bounds (ms) of an Eastern wall-clock window, daylight saving respected."""
    part = lambda i: F.regexp_extract(question, WINDOW, i)
    number = lambda i: part(i).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(1)))

    def hour(h: int, half: int) -> Column:
        base = F.pmod(number(h), F.lit(12))
        return F.when(part(half) == "PM", base + 12).otherwise(base)

    def at(h: int, m: int, half: int) -> Column:
        ok = (month > 0) & number(2).between(1, 31) & number(h).between(1, 12) & number(m).between(0, 59)
        text = F.format_string(
            "%04d-%02d-%02d %02d:%02d:00", year.cast("int"), month.cast("int"), number(2), hour(h, half), number(m)
        )
        local = F.when(ok, text).try_cast("timestamp_ntz")
        return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), "America/New_York"))

    start, end = at(3, 4, 5), at(6, 7, 8)
    ok = end > start
    return {"start_ms": F.when(ok, start), "end_ms": F.when(ok, end)}


def extract_source(source: Column, rules: Column) -> Column:
    """The source field, else the venue URL named in the rules, else empty."""
    url = r"(?i)https?://[^\s\"']*(?:chain\.link|binance\.com|coinbase\.com)[^\s\"']*"
    found = F.regexp_extract(F.coalesce(rules, F.lit("")), url, 0)
    return F.when(~blank(source), source).otherwise(found)


def _has_venue(text: Column, venues: Sequence[str] = VENUES) -> Column:
    out = F.lit(False)
    for v in venues:
        out = out | text.contains(v)
    return out


def grade_by_strike(source: Column, rules: Column, strike: Column) -> Column:
    """EXACT needs a venue source, more than 50 characters of rules and a strike."""
    src, txt = F.lower(F.coalesce(source, F.lit(""))), F.coalesce(rules, F.lit(""))
    priced = strike.isNotNull() & ~F.isnan(strike) & (strike > 0) & (strike < float("inf"))
    return (
        F.when(_has_venue(src) & (F.length(txt) > 50) & priced, "EXACT")
        .when((txt != "") | (src != ""), "PROXY")
        .otherwise("UNKNOWN")
    )


def grade_by_window(
    asset: Column, horizon: Column, question: Column, end_ms: Column, source: Column,
    rules: Column, year: Column,
) -> Column:
    """EXACT needs a venue, the asset's name and a window that fits end and horizon."""
    src, txt = F.coalesce(source, F.lit("")), F.coalesce(rules, F.lit(""))
    text = F.lower(F.concat_ws(" ", src, txt))
    q = F.lower(F.coalesce(question, F.lit("")))
    bounds = parse_window(question, year)
    start, end = bounds["start_ms"], bounds["end_ms"]
    secs = F.lit(-1)
    for name, s in HORIZON_TARGETS.items():
        secs = F.when(horizon == name, F.lit(s)).otherwise(secs)
    named = ~((asset == "BTC") & ~q.contains("bitcoin")) & ~((asset == "ETH") & ~q.contains("ethereum"))
    fits = (
        start.isNotNull()
        & (F.abs(end_ms - end) <= 60_000)
        & (secs == F.floor((end - start) / 1000))
    )
    grounded = _has_venue(text) & (F.length(txt) > 50)
    return (
        F.when(~grounded & (src == "") & (txt == ""), "UNKNOWN")
        .when(grounded & named & F.coalesce(fits, F.lit(False)), "EXACT")
        .otherwise("PROXY")
    )


# The reasons of a metadata rejection, in order.
METADATA_REASONS = (
    "missing_raw_market", "invalid_asset", "asset_mismatch", "invalid_5m_slug",
    "missing_market_start", "invalid_market_start", "invalid_duration",
    "slug_start_mismatch", "missing_exact_question_rules", "metadata_mismatch",
)


def validate_metadata(raw: DataFrame, meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """Left joins raw markets and metadata to the wanted ids; first failed rule wins."""
    r = raw.select(
        F.col("condition_id"), F.lit(True).alias("_has_raw"), F.col("asset").alias("_asset"),
        F.col("slug").alias("_slug"), F.col("market_start_ms").alias("_start"),
        F.col("market_end_ms").alias("_end"),
    )
    m = meta.select(
        F.col("condition_id"), F.lit(True).alias("_has_meta"), F.col("asset").alias("_masset"),
        F.col("horizon").alias("_mhorizon"), F.col("slug").alias("_mslug"), "question", "resolution_rules",
    )
    df = wanted.join(r, "condition_id", "left").join(m, "condition_id", "left")
    bits = F.split("_slug", "-")
    slug_start = F.get(bits, F.lit(3))
    start_ok = slug_start.rlike(r"^[+-]?[0-9]+$") & (F.size(bits) == 4)
    start, end = F.col("_start"), F.col("_end")
    checks = (
        F.col("_has_raw").isNull(),
        ~F.col("_asset").isin("BTC", "ETH"),
        F.get(bits, F.lit(0)) != F.lower("_asset"),
        ~F.coalesce(
            (F.get(bits, F.lit(1)) == "updown") & (F.get(bits, F.lit(2)) == "5m") & start_ok,
            F.lit(False),
        ),
        start.isNull(),
        start <= 0,
        F.coalesce(end - start != 300_000, F.lit(True)),
        (F.pmod(start, F.lit(1000)) != 0)
        | F.coalesce(F.floor(start / 1000) != slug_start.try_cast("bigint"), F.lit(True)),
        F.col("_has_meta").isNull() | blank(F.col("question")) | blank(F.col("resolution_rules")),
        (F.col("_masset") != F.col("_asset"))
        | (F.col("_mhorizon") != "5m")
        | (F.col("_mslug") != F.col("_slug")),
    )
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(zip(METADATA_REASONS, checks, strict=True))):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return df.select(*wanted.columns, reason.alias("reject_reason"))


RULE_FIELDS = (
    "resolutionRules", "resolution_rules", "resolutionCriteria", "resolution_criteria",
    "rules", "description",
)


def payload_text_ok(df: DataFrame, payload: str, expected_source: str) -> Column:
    """Columns must repeat, word for word, the JSON payload they were taken from."""
    get = lambda f: F.get_json_object(payload, f"$.{f}")
    payload_id = F.coalesce(*[F.when(~blank(get(f)), get(f)) for f in ("conditionId", "condition_id")])
    rules = field = F.lit(None).cast("string")
    for f in reversed(RULE_FIELDS):
        rules = F.when(~blank(get(f)), get(f)).otherwise(rules)
        field = F.when(~blank(get(f)), F.lit(f)).otherwise(field)
    low = lambda c: F.lower(F.trim(c))
    ok = (
        (F.col("source_url") == expected_source)
        & ~blank(F.col("condition_id"))
        & (low(F.col("payload_condition_id")) == low(F.col("condition_id")))
        & (low(payload_id) == low(F.col("condition_id")))
        & ~blank(get("id")) & (get("id") == F.col("payload_market_id"))
        & ~blank(get("question")) & (get("question") == F.col("question"))
        & (rules == F.col("resolution_rules"))
        & (field == F.col("rules_source_field"))
    )
    return F.coalesce(ok, F.lit(False))


def error_class(error: Column) -> Column:
    low = F.lower(error)
    return (
        F.when(error.contains("429"), "429")
        .when(error.contains("HTTP status 5"), "5xx")
        .when(low.contains("deadline") | low.contains("timeout"), "deadline")
        .otherwise("other")
    )

"""Row functions over quotes, prints, texts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelab.functions import decisions, prices, quant, signals, text, times
from tapelab.plans.registry import query, r

col = F.col


@query("P1_yes_price", using="prints", sql="""
SELECT seq, CASE WHEN event_type IN ('click', 'error') THEN 1.0::DOUBLE - price ELSE price END AS yes_price,
  event_type <> 'signup' AS yes_normalized FROM prints""")
def _(t):
    label = (
        F.when(col("event_type") == "view", "Yes").when(col("event_type") == "click", " NO ")
        .when(col("event_type") == "purchase", "Up").when(col("event_type") == "error", "down")
        .otherwise("Maybe")
    )
    return t.prints.withColumn("label", label).withColumns(
        prices.yes_price(col("price"), col("label"))
    ).select("seq", "yes_price", "yes_normalized")


@query("P2_complement", using="quotes", sql="""
WITH n AS (SELECT seq, CASE WHEN event_type = 'error' THEN yes_ask * 2 ELSE yes_bid END AS b,
  CASE WHEN event_type = 'signup' THEN yes_bid - 0.001 ELSE yes_ask END AS a, size AS bs, size + 1 AS s FROM quotes),
k AS (SELECT *, CASE WHEN NOT (b BETWEEN 0 AND 1 AND a BETWEEN 0 AND 1) THEN 'range' WHEN b > a THEN 'bad_spread' END AS reject_reason FROM n)
SELECT seq, reject_reason,
  CASE WHEN reject_reason IS NULL THEN 1.0::DOUBLE - a END AS yes_bid, CASE WHEN reject_reason IS NULL THEN 1.0::DOUBLE - b END AS yes_ask,
  CASE WHEN reject_reason IS NULL THEN s END AS yes_bid_size, CASE WHEN reject_reason IS NULL THEN bs END AS yes_ask_size,
  CASE WHEN reject_reason IS NULL THEN 1.0::DOUBLE - (b + a) / 2.0::DOUBLE END AS yes_mid, 'SYNTHETIC_COMPLEMENT' AS fidelity FROM k""")
def _(t):
    no = t.quotes.select(
        "seq",
        F.when(col("event_type") == "error", col("yes_ask") * 2).otherwise(col("yes_bid")).alias("no_bid"),
        F.when(col("event_type") == "signup", col("yes_bid") - F.lit(0.001)).otherwise(col("yes_ask")).alias("no_ask"),
        col("size").alias("no_bid_size"), (col("size") + 1).alias("no_ask_size"),
    )
    return prices.complement(no).select(
        "seq", "reject_reason", "yes_bid", "yes_ask", "yes_bid_size", "yes_ask_size", "yes_mid", "fidelity"
    )


@query("P3_micros", sql="""
SELECT event_id, CAST(round(value / 600 * 1000000) AS BIGINT) AS micros,
  CAST(round(value / 600 * 1000000) AS BIGINT) / 1000000.0::DOUBLE AS price,
  CAST(round(value / 600 * 1000000) AS BIGINT) % 2500 = 0 AS on_tick FROM events""")
def _(t):
    p = col("value") / 600
    return t.raw("events").select(
        "event_id", prices.to_micros(p).alias("micros"),
        prices.from_micros(prices.to_micros(p)).alias("price"),
        prices.is_tick_multiple(p, F.lit(0.0025)).alias("on_tick"),
    )


@query("P4_candidate_price", using="quotes", sql="""
WITH k AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 10000 ELSE 2500 END AS tick FROM quotes),
c AS (SELECT *, ((bid_micros + tick + tick - 1) // tick) * tick AS cand FROM k)
SELECT seq, CASE WHEN cand <= 1000000 AND cand < ask_micros THEN cand END AS candidate FROM c""")
def _(t):
    tick = F.when(col("user_id") % 2 == 0, 10000).otherwise(2500)
    return t.quotes.select(
        "seq", prices.candidate_micros(col("bid_micros"), col("ask_micros"), tick).alias("candidate")
    )


@query("P5_valid_quote", using="quotes", sql="""
WITH q AS (SELECT seq, yes_bid AS b, yes_ask * 1.5 AS a, CASE WHEN event_type = 'view' THEN yes_bid + 0.01 END AS m FROM quotes),
k AS (SELECT *, coalesce(m, (b + a) / 2.0::DOUBLE) AS mid FROM q)
SELECT seq, (b BETWEEN 0 AND 1 AND a BETWEEN 0 AND 1 AND mid BETWEEN 0 AND 1) AS quote_ok,
  CASE WHEN b BETWEEN 0 AND 1 AND a BETWEEN 0 AND 1 AND mid BETWEEN 0 AND 1 THEN mid END AS quote_mid FROM k""")
def _(t):
    df = t.quotes.select(
        "seq", "yes_bid", (col("yes_ask") * 1.5).alias("yes_ask"),
        F.when(col("event_type") == "view", col("yes_bid") + 0.01).alias("given"),
    )
    return prices.valid_quote(df, mid="given").select("seq", "quote_ok", "quote_mid")


@query("P6_first_available", using="quotes", sql="""
SELECT seq, CASE event_type WHEN 'view' THEN yes_bid WHEN 'click' THEN size WHEN 'error' THEN size END AS ask_size,
  yes_ask - yes_bid AS spread, (yes_bid + yes_ask) / 2.0::DOUBLE AS mid FROM quotes""")
def _(t):
    a = F.when(col("event_type") == "view", col("yes_bid")).when(col("event_type") == "click", F.lit(float("nan")))
    b = F.when(col("event_type").isin("click", "error"), col("size")).otherwise(F.lit(float("nan")))
    gap = prices.spread_mid(col("yes_bid"), col("yes_ask"))
    return t.quotes.select(
        "seq", prices.first_available(a, b).alias("ask_size"), *[v.alias(k) for k, v in gap.items()]
    )


@query("P7_epoch_ms", using="ticks", sql="""
SELECT seq, CASE event_type WHEN 'view' THEN ts_ms // 1000 * 1000 WHEN 'error' THEN NULL ELSE ts_ms END AS parsed_ms FROM ticks""")
def _(t):
    ts = col("ts_ms")
    stamp = F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = (
        F.when(col("event_type") == "view", F.floor(ts / 1000).cast("string"))
        .when(col("event_type") == "click", ts.cast("string"))
        .when(col("event_type") == "purchase", (ts * 1000 + 7).cast("string"))
        .when(col("event_type") == "signup", stamp)
        .otherwise("NaT")
    )
    return t.ticks.select("seq", times.epoch_ms(raw).alias("parsed_ms"))


_HW = {h: ", ".join(f"'{w}'" for w in ws) for h, ws in text.HORIZON_WORDS.items()}
_HCASE = " ".join(f"WHEN w IN ({ws}) THEN '{h}'" for h, ws in _HW.items())
_ALL = ", ".join(_HW.values())


@query("P8_classify_market", sql=f"""
WITH d AS (SELECT doc_id, lower(text || ' ' || source) AS blob, n_chars FROM documents),
k AS (SELECT *, list_filter(string_split_regex(blob, '[^a-z0-9]+'), lambda x: x <> '') AS tok FROM d),
j AS (SELECT *, list_filter(tok, lambda x: x IN ({_ALL}))[1] AS w1,
  list_filter(list_transform(range(1, len(tok)), lambda i: tok[i] || tok[i + 1]), lambda x: x IN ({_ALL}))[1] AS w2 FROM k),
h AS (SELECT *, coalesce(w1, w2) AS w FROM j)
SELECT doc_id,
  CASE WHEN (contains(blob,'btc') OR contains(blob,'bitcoin')) AND NOT contains(blob,'eth') THEN 'BTC'
       WHEN contains(blob,'eth') AND NOT (contains(blob,'btc') OR contains(blob,'bitcoin')) THEN 'ETH' ELSE '' END AS asset,
  CASE {_HCASE} WHEN abs(n_chars - 300) / 300 < 0.05 THEN '5m' WHEN abs(n_chars - 900) / 900 < 0.05 THEN '15m'
    WHEN abs(n_chars - 3600) / 3600 < 0.05 THEN '1h' WHEN abs(n_chars - 14400) / 14400 < 0.05 THEN '4h' ELSE '' END AS horizon,
  CASE WHEN contains(blob,'up or down') OR contains(blob,'updown') OR contains(blob,'up-down') THEN 'UPDOWN'
       WHEN contains(blob,'below') OR contains(blob,'under') OR contains(blob,'less than') THEN 'BELOW' ELSE 'ABOVE' END AS kind
FROM h""")
def _(t):
    return t.raw("documents").select(
        "doc_id",
        text.guess_asset(col("text"), col("source")).alias("asset"),
        text.guess_horizon(col("text"), col("source"), duration_s=col("n_chars")).alias("horizon"),
        text.guess_kind(col("text"), col("source")).alias("kind"),
    )


@query("P9_extract_strike")
def _(t):
    asset = F.when(col("doc_id") % 2 == 0, "BTC").otherwise("ETH")
    df = t.wide.raw("documents").select("doc_id", "text", "source", asset.alias("asset"))
    return text.extract_strike(df, "text", "source", "asset").select("doc_id", "reference", "strike")


def _window_question(hour):
    start = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + hour * 3600)
    end = F.timestamp_seconds(F.unix_timestamp(start) + 900)
    return F.concat(
        F.lit("Bitcoin Up or Down - "), F.date_format(start, "MMMM d, h:mma"), F.lit("-"),
        F.date_format(end, "h:mma"), F.lit(" ET"),
    )


@query("P10_parse_window", sql="""
SELECT o_orderkey, epoch_ms(timezone('America/New_York', o_orderdate + to_hours(CAST(9 + o_orderkey % 8 AS INTEGER)))) AS start_ms,
  epoch_ms(timezone('America/New_York', o_orderdate + to_hours(CAST(9 + o_orderkey % 8 AS INTEGER)))) + 900000 AS end_ms FROM orders""")
def _(t):
    df = t.raw("orders").withColumn("question", _window_question(9 + col("o_orderkey") % 8))
    bounds = text.parse_window(col("question"), F.year("o_orderdate"))
    return df.select("o_orderkey", *[v.alias(k) for k, v in bounds.items()])


@query("P11_extract_source", sql=r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN '  ' END AS source,
  CASE WHEN page_id % 2 = 0 THEN html || ' see https://www.binance.com/en/trade/' || page_id || '" end' ELSE html END AS rules FROM pages)
SELECT page_id, CASE WHEN trim(coalesce(source, '')) <> '' THEN source
  ELSE regexp_extract(rules, '(?i)https?://[^\s"'']*(?:chain\.link|binance\.com|coinbase\.com)[^\s"'']*') END AS source_url FROM p""")
def _(t):
    src = F.when(col("page_id") % 3 == 0, col("url")).when(col("page_id") % 3 == 1, "  ")
    rules = F.when(
        col("page_id") % 2 == 0,
        F.concat("html", F.lit(" see https://www.binance.com/en/trade/"), col("page_id").cast("string"), F.lit('" end')),
    ).otherwise(col("html"))
    return t.raw("pages").select("page_id", text.extract_source(src, rules).alias("source_url"))


@query("P12_grade_by_strike", sql="""
WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'https://BINANCE.com' WHEN 'fr' THEN 'other' ELSE '' END AS src,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS rules, CASE WHEN n_chars > 400 THEN n_chars END AS strike FROM documents)
SELECT doc_id, CASE WHEN contains(lower(src), 'binance') AND length(rules) > 50 AND strike > 0 THEN 'EXACT'
  WHEN rules <> '' OR src <> '' THEN 'PROXY' ELSE 'UNKNOWN' END AS fidelity FROM d""")
def _(t):
    src = F.when(col("lang") == "en", "https://BINANCE.com").when(col("lang") == "fr", "other").otherwise("")
    rules = F.when(col("doc_id") % 5 == 0, "").otherwise(col("text"))
    strike = F.when(col("n_chars") > 400, col("n_chars")).cast("double")
    return t.raw("documents").select("doc_id", text.grade_by_strike(src, rules, strike).alias("fidelity"))


@query("P12_grade_by_window", sql="""
WITH d AS (SELECT o_orderkey, 'Settles on ' || CASE WHEN o_orderkey % 4 = 0 THEN 'a poll' ELSE 'Chainlink' END
    || repeat(' price', CAST(o_orderkey % 12 AS INTEGER)) AS rules,
  CASE WHEN o_custkey % 3 = 0 THEN 'ETH' ELSE 'BTC' END AS asset, CASE WHEN o_orderkey % 7 = 0 THEN '5m' ELSE '15m' END AS horizon,
  CASE WHEN o_custkey % 5 = 0 THEN 61 ELSE 60 END AS late FROM orders)
SELECT o_orderkey, CASE WHEN contains(rules, 'Chainlink') AND length(rules) > 50 AND asset = 'BTC' AND late = 60 AND horizon = '15m'
  THEN 'EXACT' ELSE 'PROXY' END AS fidelity FROM d""")
def _(t):
    df = t.raw("orders").withColumn("question", _window_question(9 + col("o_orderkey") % 8))
    bounds = text.parse_window(col("question"), F.year("o_orderdate"))
    rules = F.concat(
        F.lit("Settles on "), F.when(col("o_orderkey") % 4 == 0, "a poll").otherwise("Chainlink"),
        F.repeat(F.lit(" price"), (col("o_orderkey") % 12).cast("int")),
    )
    late = F.when(col("o_custkey") % 5 == 0, 61_000).otherwise(60_000)
    grade = text.grade_by_window(
        F.when(col("o_custkey") % 3 == 0, "ETH").otherwise("BTC"),
        F.when(col("o_orderkey") % 7 == 0, "5m").otherwise("15m"),
        col("question"), bounds["end_ms"] + late, F.lit(""), rules, F.year("o_orderdate"),
    )
    return df.select("o_orderkey", grade.alias("fidelity"))


@query("P13_validate_metadata", sql="""
WITH o AS (SELECT o_orderkey AS id, o_custkey % 13 AS d, epoch_ms(o_orderdate) AS ms FROM orders)
SELECT id AS condition_id, CASE d WHEN 1 THEN 'missing_raw_market' WHEN 2 THEN 'invalid_asset' WHEN 3 THEN 'asset_mismatch'
  WHEN 4 THEN 'invalid_5m_slug' WHEN 5 THEN 'missing_market_start' WHEN 6 THEN 'invalid_market_start' WHEN 7 THEN 'invalid_duration'
  WHEN 8 THEN 'slug_start_mismatch' WHEN 9 THEN 'missing_exact_question_rules' WHEN 10 THEN 'missing_exact_question_rules'
  WHEN 11 THEN 'metadata_mismatch' END AS reject_reason FROM o""")
def _(t):
    o = t.raw("orders").select(
        col("o_orderkey").alias("condition_id"), (col("o_custkey") % 13).alias("d"),
        F.unix_millis(col("o_orderdate").cast("timestamp")).alias("ms"),
    )
    d, ms = col("d"), col("ms")
    slug = F.concat(
        F.when(d == 3, "eth").otherwise("btc"), F.lit("-updown-"), F.when(d == 4, "15m").otherwise("5m"), F.lit("-"),
        F.floor(F.when(d == 8, ms + 1000).otherwise(ms) / 1000).cast("string"),
    )
    start = F.when(d == 5, F.lit(None)).when(d == 6, -ms).otherwise(ms)
    raw = o.where(d != 1).select(
        "condition_id", F.when(d == 2, "XRP").otherwise("BTC").alias("asset"), slug.alias("slug"),
        start.alias("market_start_ms"), (start + F.when(d == 7, 300_001).otherwise(300_000)).alias("market_end_ms"),
    )
    meta = o.where(d != 9).select(
        "condition_id", F.lit("BTC").alias("asset"), F.when(d == 11, "15m").otherwise("5m").alias("horizon"),
        slug.alias("slug"), F.lit("Up or down?").alias("question"),
        F.when(d == 10, "  ").otherwise("rules").alias("resolution_rules"),
    )
    return text.validate_metadata(raw, meta, o.select("condition_id"))


@query("P14_payload_text", sql="""
SELECT doc_id, (lang <> 'fr' AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND trim(text) <> '') AS verbatim FROM documents""")
def _(t):
    df = t.raw("documents").select(
        "doc_id",
        F.concat(F.lit("0xAB"), col("doc_id").cast("string")).alias("condition_id"),
        F.concat(F.lit(" 0xab"), col("doc_id").cast("string")).alias("payload_condition_id"),
        F.when(col("doc_id") % 5 == 0, "none").otherwise(col("doc_id").cast("string")).alias("payload_market_id"),
        F.when(col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(col("text")).alias("question"),
        F.concat(F.lit("Rules: "), "text").alias("resolution_rules"),
        F.when(col("doc_id") % 4 == 0, "rules").otherwise("description").alias("rules_source_field"),
        F.lit("markets-api").alias("source_url"),
        F.to_json(
            F.struct(
                F.concat(F.lit("0xab"), col("doc_id").cast("string")).alias("conditionId"),
                col("doc_id").alias("id"), col("text").alias("question"),
                F.concat(F.lit("Rules: "), "text").alias("description"),
            )
        ).alias("payload"),
    )
    return df.select("doc_id", text.payload_text_ok(df, "payload", "markets-api").alias("verbatim"))


@query("P15_first_text", sql="""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 3 = 0 THEN source WHEN trim(lang) <> '' THEN lang END AS text,
  CASE WHEN doc_id % 2 = 0 THEN 'rules' WHEN doc_id % 3 = 0 THEN 'description' WHEN trim(lang) <> '' THEN 'title' END AS field
FROM documents""")
def _(t):
    df = t.raw("documents").select(
        "doc_id", F.when(col("doc_id") % 2 == 0, col("text")).alias("rules"),
        F.when(col("doc_id") % 3 == 0, col("source")).otherwise("  ").alias("description"), col("lang").alias("title"),
    )
    got = text.first_text("rules", "description", "title")
    return df.select("doc_id", *[v.alias(k) for k, v in got.items()])


def _answer_json(t, pressure=False):
    """Answers built from line items; some lines carry a defect on purpose."""
    e = t.evals
    noul = lambda c: F.struct(F.lit("noul").alias("type"), c.alias("noul"))
    if pressure:
        names = list(signals.PRESSURE_LEVELS)
        half = col("underreact_up") / 2
        values = [half, F.lit(0.0), 1 - col("underreact_up"), F.lit(0.0), half + F.when(col("l_linenumber") == 5, 1).otherwise(0)]
        keys = [F.when(col("l_linenumber") == 3, F.lit("SIDEWAYS")).otherwise(F.lit(n)) if n == "NEUTRAL" else F.lit(n) for n in names]
        probs = F.map_from_arrays(F.array(*keys), F.array(*values))
        choice = F.struct(F.lit("choice").alias("type"), probs.alias("probabilities"),
                          F.when(col("l_linenumber") != 4, col("move_persists")).alias("confidence"))
        body = F.struct(F.struct(choice.alias("pressure_5s")).alias("answers"))
    else:
        up = col("underreact_up") / 2
        values = [up, F.lit(0.0), up, 1 - 2 * up, F.when(col("l_linenumber") == 4, 0.25).otherwise(0.0), F.lit(0.0), F.lit(0.0)]
        keys = [F.when(col("l_linenumber") == 3, F.lit("SIDEWAYS")).otherwise(F.lit(b)) if b == "FLAT" else F.lit(b) for b in signals.BUCKETS]
        probs = F.map_from_arrays(F.array(*keys), F.array(*values))
        choice = F.struct(F.when(col("l_linenumber") == 7, "noul").otherwise("choice").alias("type"), probs.alias("probabilities"),
                          F.when(col("l_linenumber") != 6, col("move_persists")).alias("confidence"))
        fields = {n: noul(col(n)) for n in signals.PROBABILITY_ANSWERS}
        fields["move_persists"] = noul(F.when(col("l_linenumber") == 5, col("move_persists") + 2).otherwise(col("move_persists")))
        answers = F.struct(choice.alias("repricing_ticks"), *[v.alias(k) for k, v in fields.items()])
        body = F.struct(answers.alias("answers"))
    text_ = F.to_json(body)
    broken = F.when(col("l_quantity_bad"), F.concat(F.lit("{"), text_)).otherwise(text_)
    return e.withColumn("l_quantity_bad", col("move_persists") == 1.0).withColumn("json", broken)


_IDS = ("pair_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("P16_parse_signal", using="evals", sql="""
WITH k AS (SELECT *, CASE WHEN move_persists = 1.0 THEN 'json' WHEN l_linenumber = 7 THEN 'answer_type:repricing_ticks'
  WHEN l_linenumber = 3 THEN 'unexpected_bucket' WHEN l_linenumber = 4 THEN 'distribution_sum'
  WHEN l_linenumber = 6 THEN 'missing_field:repricing_ticks.confidence'
  WHEN l_linenumber = 5 THEN 'probability:move_persists' END AS signal_error FROM evals)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, signal_error,
  CASE WHEN signal_error IS NULL THEN round(underreact_up / 2 + 0.0 + underreact_up / 2, 6) END AS p_up,
  CASE WHEN signal_error IS NULL THEN fill_toxic END AS fill_toxic,
  CASE WHEN signal_error IS NULL THEN move_persists END AS repricing_confidence FROM k""")
def _(t):
    got = signals.parse_signal(_answer_json(t.wide), "json")
    return got.select(
        *_IDS, "signal_error", r("signal.p_up", "p_up"), col("signal.fill_toxic").alias("fill_toxic"),
        col("signal.repricing_confidence").alias("repricing_confidence"),
    )


@query("P17_parse_pressure", using="evals", sql="""
WITH k AS (SELECT *, CASE WHEN move_persists = 1.0 THEN 'json' WHEN l_linenumber = 3 THEN 'unexpected_bucket'
  WHEN l_linenumber = 5 AND underreact_up > 0 THEN 'bucket_probability'
  WHEN l_linenumber = 4 THEN 'missing_field:pressure_5s.confidence' END AS pressure_error FROM evals)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, pressure_error,
  CASE WHEN pressure_error IS NULL THEN CASE WHEN l_linenumber = 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS pressure,
  CASE WHEN pressure_error IS NULL THEN move_persists END AS pressure_confidence FROM k""")
def _(t):
    got = signals.parse_pressure(_answer_json(t.wide, pressure=True), "json")
    return got.select(*_IDS, "pressure_error", r("pressure", "pressure"), "pressure_confidence")


@query("P17_parse_fair_value", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 3 THEN 'missing_field:fair_p_yes' WHEN l_linenumber = 5 THEN 'probability:fair_p_yes'
  WHEN l_linenumber = 6 THEN 'missing_answer:fair_p_yes' END AS fair_error, CASE WHEN l_linenumber NOT IN (3, 5, 6) THEN fair_p_yes END AS fair_p_yes FROM evals""")
def _(t):
    value = F.when(col("l_linenumber") == 5, col("fair_p_yes") + 2).when(col("l_linenumber") != 3, col("fair_p_yes"))
    answer = F.struct(F.lit("noul").alias("type"), value.alias("noul"))
    body = F.struct(F.struct(F.when(col("l_linenumber") != 6, answer).alias("fair_p_yes")).alias("answers"))
    rows = t.wide.evals.select(*_IDS, F.to_json(body).alias("json"))
    return signals.parse_fair_value(rows, "json").select(*_IDS, "fair_error", "fair_p_yes")


@query("P18_p_up", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(underreact_up / 2 + CASE WHEN l_linenumber <> 2 THEN underreact_up / 4 ELSE 0 END, 6) AS p_up FROM evals""")
def _(t):
    buckets = F.to_json(F.struct((col("underreact_up") / 2).alias("up_3_plus"), F.when(col("l_linenumber") != 2, col("underreact_up") / 4).alias("up_1")))
    return t.evals.select(*_IDS, r(signals.p_up_from_buckets(buckets), "p_up"))


@query("P18_extract_features", using="quotes", sql="""
SELECT seq, size AS ret_5s_pct, 0.0::DOUBLE AS ofi_5s, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE yes_bid END AS move_zscore_1s,
  CASE WHEN event_type = 'click' THEN 0.5::DOUBLE ELSE (ask_micros - bid_micros) / 1000000.0::DOUBLE END AS spread FROM quotes""")
def _(t):
    state = F.to_json(
        F.struct(
            F.struct(col("size").alias("ret_5s_pct")).alias("underlying"),
            F.when(col("event_type") != "view", F.struct(col("yes_bid").alias("move_zscore_1s"))).alias("quant"),
            F.struct(
                col("bid_micros").alias("yes_bid"), col("ask_micros").alias("yes_ask"),
                F.when(col("event_type") == "click", 0.5).alias("spread"),
            ).alias("book"),
        )
    )
    got = signals.extract_features(t.quotes.withColumn("state", state), "state", quotes="book")
    return got.select("seq", "ret_5s_pct", "ofi_5s", "move_zscore_1s", "spread")


@query("P19_state_hash", using="ticks", sql="""
SELECT seq, sha256('{"asset":"' || asset || '","inner":{"a":' || user_id || ',"b":"' || event_type || '"},"ts_ms":' || ts_ms || '}') AS state_hash FROM ticks""")
def _(t):
    state = F.struct(
        "ts_ms", "asset", F.struct(col("event_type").alias("b"), col("user_id").alias("a")).alias("inner")
    )
    df = t.ticks.select("seq", state.alias("state"))
    return df.select("seq", signals.state_hash(df, "state").alias("state_hash"))


@query("P20_pair_id", using="ticks", sql="""
SELECT seq, asset || ':' || ts_ms || ':' || substr(sha256(asset), 1, 12) AS pair_id,
  CASE WHEN user_id % 2 = 0 THEN 'run-' || lpad(seq::VARCHAR, greatest(6, length(seq::VARCHAR))::INTEGER, '0')
    ELSE 'run-' || asset || '-' || lpad(seq::VARCHAR, greatest(6, length(seq::VARCHAR))::INTEGER, '0') END AS replay_pair_id FROM ticks""")
def _(t):
    ns = F.when(col("user_id") % 2 == 0, "").otherwise(col("asset"))
    return t.ticks.select(
        "seq", signals.pair_id(col("asset"), col("ts_ms"), F.sha2("asset", 256)).alias("pair_id"),
        signals.replay_pair_id(F.lit("run"), ns, col("seq")).alias("replay_pair_id"),
    )


@query("P21_audit_causality", using="ticks", sql="""
SELECT seq, CASE WHEN event_type = 'error' THEN 'future_input' WHEN event_type IN ('click','signup') THEN 'forbidden_field' ELSE 'ok' END AS verdict,
  CASE WHEN event_type = 'error' THEN 'spot' END AS late_input, CASE WHEN event_type = 'error' THEN ts_ms + 1 END AS late_input_ts_ms,
  CASE event_type WHEN 'click' THEN 'outcome' WHEN 'signup' THEN 'resolved_ts_ms' END AS forbidden_field FROM ticks""")
def _(t):
    late = F.when(col("event_type") == "error", 1).otherwise(0)
    inputs = F.array(
        F.struct(F.lit("book").alias("name"), col("ts_ms").alias("ts_ms")),
        F.struct(F.lit("spot").alias("name"), (col("ts_ms") + late).alias("ts_ms")),
    )
    key = F.when(col("event_type") == "click", "outcome").when(col("event_type") == "signup", "resolved_ts_ms").otherwise("side")
    state = F.concat(F.lit('{"a":[{"b":{"'), key, F.lit('" : 1}}],"note":"the \\"outcome\\": open"}'))
    df = t.ticks.select("seq", "ts_ms", inputs.alias("inputs"), state.alias("state"))
    got = signals.audit_causality(df, "ts_ms", "inputs", "state")
    return got.select("seq", "verdict", "late_input", "late_input_ts_ms", "forbidden_field")


@query("P22_bucket_regime", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN drift_5s_pp > 0.1 THEN 'bull' WHEN drift_5s_pp < -0.1 THEN 'bear' ELSE 'sideways' END AS trend_bucket,
  CASE WHEN latency_ms > 240 THEN 'far' WHEN latency_ms >= 60 THEN 'mid' WHEN latency_ms >= 10 THEN 'near' ELSE 'very_near' END AS time_bucket,
  CASE WHEN drift_1s_pp IS NULL THEN 'pos_0_to_1' WHEN drift_1s_pp < -2 THEN 'neg_beyond_2' WHEN drift_1s_pp < -1 THEN 'neg_2_to_1'
    WHEN drift_1s_pp < 0 THEN 'neg_1_to_0' WHEN drift_1s_pp < 1 THEN 'pos_0_to_1' WHEN drift_1s_pp <= 2 THEN 'pos_1_to_2' ELSE 'pos_beyond_2' END AS sigma_bucket,
  CASE WHEN pressure > 0.3 THEN 'strong_buy' ELSE 'neutral' END AS flow_bucket,
  CASE WHEN markout_5s_pp > 0.0005 THEN 'positive' WHEN markout_5s_pp < -0.0005 THEN 'negative' ELSE 'neutral' END AS basis_bucket FROM evals""")
def _(t):
    df = t.evals.withColumns(
        {
            "trend_score": col("drift_5s_pp"), "minutes_to_resolution": col("latency_ms"),
            "distance_sigma": col("drift_1s_pp"), "ofi": col("pressure"), "basis": col("markout_5s_pp"),
        }
    )
    return quant.bucket_regime(df).select(
        *_IDS, "trend_bucket", "time_bucket", "sigma_bucket", "flow_bucket", "basis_bucket"
    )


def _quant_input(t):
    return t.evals.withColumns(
        {
            "ret_1s_pct": col("drift_1s_pp") / 100, "realized_vol_1m_pct": col("pressure") / 10,
            "realized_vol_5m_pct": col("fair_p_yes") / 20, "spot": col("ret_5s_pct"),
            "target": col("ret_5s_pct") * (1 + col("drift_5s_pp") / 1000),
            "distance_to_target_pct": col("drift_5s_pp") / 10,
            "time_remaining_secs": col("latency_ms").cast("long"),
        }
    )


@query("P23_quant_features", using="evals", sql="""
WITH k AS (SELECT *, greatest(pressure / 10, 1e-6) AS sigma, greatest(fair_p_yes / 20, 1e-6) AS v5 FROM evals)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round(coalesce(drift_1s_pp / 100 / sigma, 0), 6) AS move_zscore_1s, sigma AS z_vol_pct,
  round(CASE WHEN latency_ms > 0 THEN coalesce(drift_5s_pp / 10 / (sigma * sqrt(latency_ms)), 0) ELSE 0 END, 6) AS distance_sigma,
  round(sigma / v5, 6) AS vol_regime_ratio FROM k""")
def _(t):
    return quant.quant_features(_quant_input(t)).select(
        *_IDS, r("move_zscore_1s", "move_zscore_1s"), "z_vol_pct", r("distance_sigma", "distance_sigma"),
        r("vol_regime_ratio", "vol_regime_ratio"),
    )


# The distribution function by its power series near zero and the continued fraction of its tail further out.
@query("P23_baseline_probability", using="evals", sql="""
WITH k AS (SELECT *, greatest(pressure / 10, 1e-6) / 100 AS s, ret_5s_pct AS spot, ret_5s_pct * (1 + drift_5s_pp / 1000) AS target, latency_ms::BIGINT AS secs FROM evals),
d AS (SELECT *, spot > 0 AND target > 0 AND isfinite(spot) AND isfinite(target) AS usable,
  CASE WHEN spot > 0 AND target > 0 AND secs > 0 THEN (ln(spot / target) - 0.5 * s * s * secs) / (s * sqrt(secs)) END AS z FROM k),
c AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS pdf, abs(z) AS x FROM d),
n AS (SELECT *, CASE
  WHEN x <= 3 THEN 0.5 + pdf * z * list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(45, 0, -1), lambda i: i::DOUBLE)), lambda t, i: 1 + z * z * t / (2 * i + 1))
  WHEN z > 0 THEN 1 - pdf / list_reduce(list_prepend(x, list_transform(range(40, 0, -1), lambda i: i::DOUBLE)), lambda t, i: x + i / t)
  ELSE pdf / list_reduce(list_prepend(x, list_transform(range(40, 0, -1), lambda i: i::DOUBLE)), lambda t, i: x + i / t) END AS p FROM c)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN NOT coalesce(usable, false) THEN 0.5
  WHEN secs = 0 THEN CASE WHEN spot > target THEN 1.0 WHEN spot < target THEN 0.0 ELSE 0.5 END ELSE coalesce(p, 0.5) END::DOUBLE, 9) AS p_yes FROM n""")
def _(t):
    return quant.quant_features(_quant_input(t.wide)).select(*_IDS, r("quant_baseline_p_yes", "p_yes", 9))


@query("P24_returns_and_distance", using="quotes", sql="""
SELECT seq, CASE WHEN yes_bid > 0 THEN (yes_ask / yes_bid - 1) * 100 END AS pct,
  CASE WHEN yes_bid > 0 THEN (yes_bid / yes_ask - 1) * 100 ELSE 0 END AS rel,
  CASE WHEN yes_bid > 0 THEN CASE WHEN event_type = 'view' THEN 0 - ((yes_bid / yes_ask - 1) * 100) ELSE (yes_bid / yes_ask - 1) * 100 END ELSE 0 END AS distance,
  CASE WHEN yes_bid > 0 THEN CASE WHEN event_type = 'view' THEN yes_bid <= yes_ask ELSE yes_bid >= yes_ask END ELSE false END AS yes_wins,
  round(CASE WHEN size > 0 THEN yes_bid / (0.01 * sqrt(size)) ELSE 0 END, 6) AS sigmas FROM quotes""")
def _(t):
    kind = F.when(col("event_type") == "view", "BELOW").otherwise("ABOVE")
    b, a = col("yes_bid"), col("yes_ask")
    return t.quotes.select(
        "seq", prices.pct_return(b, a).alias("pct"), prices.rel_diff(b, a).alias("rel"),
        (prices.distance_to_target(b, a, kind) + 0.0).alias("distance"), prices.resolves_yes(b, a, kind).alias("yes_wins"),
        r(prices.sigma_distance(b, F.lit(0.01), col("size")), "sigmas"),
    )


@query("P25_time_remaining", using="ticks", sql="""
SELECT seq, greatest(0, 1705000000000 + user_id * 10000000 - ts_ms) // 1000 AS remaining_s,
  (ts_ms >= 1705000000000 AND ts_ms < 1705000000000 + user_id * 10000000) AS active,
  ts_ms - ts_ms % (CASE user_id % 4 WHEN 0 THEN 300000 WHEN 1 THEN 900000 WHEN 2 THEN 3600000 ELSE 14400000 END) AS epoch_start FROM ticks""")
def _(t):
    end = F.lit(1705000000000) + col("user_id") * 10_000_000
    name = F.when(col("user_id") % 4 == 0, "5m").when(col("user_id") % 4 == 1, "15m").when(col("user_id") % 4 == 2, "1h").otherwise("4h")
    return t.ticks.select(
        "seq", times.time_remaining(end, col("ts_ms")).alias("remaining_s"),
        times.is_active(F.lit(1705000000000), end, col("ts_ms")).alias("active"),
        times.rollover(col("ts_ms"), times.horizon_secs(name)).alias("epoch_start"),
    )


_CUTS = {"under_min": 0.3, "next_up_min": 0.2, "persist_min": 0.2, "fill_min": 0.3, "toxic_max": 0.35, "conflict_max": 0.7, "no_pressure_max": 0.3}
_GATE_SQL = ("underreact_up > 0.3 AND p_up > 0.2 AND move_persists > 0.2 AND fill_before_decay > 0.3 "
             "AND fill_toxic < 0.35 AND underreact_down < 0.7 AND no_pressure_5s < 0.3")


@query("P26_gate", using="evals", sql=f"""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ({_GATE_SQL}) AS passes FROM evals""")
def _(t):
    return t.evals.select(*_IDS, decisions.passes_gate(_CUTS).alias("passes"))


@query("P27_decide", using="evals", sql=f"""
WITH k AS (SELECT *, CASE WHEN l_linenumber <> 6 THEN l_partkey % 900 * 1000 END AS bid, CASE WHEN l_linenumber <> 7 THEN l_partkey % 900 * 1000 + l_suppkey % 4 * 10000 END AS ask FROM evals),
c AS (SELECT *, CASE WHEN l_linenumber = 5 THEN 'size_zero' WHEN stale_skipped THEN 'stale_book' WHEN bid IS NULL THEN 'missing_bid' WHEN ask IS NULL THEN 'missing_ask'
  WHEN NOT ((bid + 19999) // 10000 * 10000 < ask) THEN 'invalid_candidate' WHEN NOT ({_GATE_SQL}) THEN 'strategy_rejected' END AS skip_reason FROM k)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, skip_reason, CASE WHEN skip_reason IS NULL THEN 'QUOTE' ELSE 'SKIP' END AS decision,
  CASE WHEN skip_reason IS NULL THEN (bid + 19999) // 10000 * 10000 END AS quote_micros FROM c""")
def _(t):
    bid = col("l_partkey") % 900 * 1000
    df = t.evals.withColumns(
        {
            "bid_micros": F.when(col("l_linenumber") != 6, bid),
            "ask_micros": F.when(col("l_linenumber") != 7, bid + col("l_suppkey") % 4 * 10000),
            "tick_micros": F.lit(10000), "size": F.when(col("l_linenumber") == 5, 0).otherwise(1),
            "book_stale": col("stale_skipped"),
        }
    )
    return decisions.decide(df, _CUTS).select(*_IDS, "skip_reason", "decision", "quote_micros")


@query("P27_risk_block", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 7 THEN 'killed' WHEN stale_skipped THEN 'stale_book'
  WHEN l_linenumber >= 4 THEN 'too_many_outstanding_quotes' WHEN latency_ms > 500 THEN 'latency_exceeded' END AS risk_reason FROM evals""")
def _(t):
    reason = decisions.risk_block(col("l_linenumber") == 7, col("stale_skipped"), col("l_linenumber"), 4, col("latency_ms"), 500)
    return t.evals.select(*_IDS, reason.alias("risk_reason"))


@query("P28_size_entry", using="evals", sql="""
WITH k AS (SELECT *, CASE WHEN NOT (fair_p_yes > 0 AND fair_p_yes < 1) THEN 'price_range' WHEN NOT (move_persists * 5 - 0.5 > 0) THEN 'stake' END AS bad,
  floor(fair_p_yes / 0.25 + 0.5) * 0.25 AS p, move_persists * 5 - 0.5 AS stake FROM evals),
s AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN floor(stake / p / 0.5) * 0.5 END AS sh FROM k),
z AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN p <= 0 OR p >= 1 THEN 'rounded_price_range' WHEN sh <= 0 THEN 'no_shares' WHEN sh < 2 THEN 'below_min_size' END AS size_reject FROM s)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, size_reject, CASE WHEN size_reject IS NULL THEN p END AS limit_price,
  CASE WHEN size_reject IS NULL THEN sh END AS shares, CASE WHEN size_reject IS NULL THEN sh * p END AS actual_notional_usd,
  CASE WHEN size_reject IS NULL THEN round(stake - sh * p, 6) END AS rounding_delta_usd FROM z""")
def _(t):
    df = t.evals.withColumn("stake", col("move_persists") * 5 - 0.5)
    got = decisions.size_entry(df, "fair_p_yes", "stake", 0.25, 0.5, 2.0)
    return got.select(
        *_IDS, "size_reject", "limit_price", "shares", "actual_notional_usd", r("rounding_delta_usd", "rounding_delta_usd")
    )


@query("P28_size_hedge", using="evals", sql="""
WITH k AS (SELECT *, floor(fair_p_yes / 0.25 + 0.5) * 0.25 AS p, move_persists * 50 / 4 AS q FROM evals),
s AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN floor(q / 0.5) * 0.5 END AS sh FROM k),
z AS (SELECT *, CASE WHEN NOT (fair_p_yes > 0 AND fair_p_yes < 1) THEN 'price_range' WHEN p <= 0 OR p >= 1 THEN 'rounded_price_range' WHEN sh <= 0 THEN 'no_shares' WHEN sh < 2 THEN 'below_min_size' END AS size_reject FROM s)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, size_reject, CASE WHEN size_reject IS NULL THEN sh END AS shares,
  CASE WHEN size_reject IS NULL THEN round(q * p, 6) END AS intended_stake_usd FROM z""")
def _(t):
    df = t.evals.withColumn("q", col("move_persists") * 50 / 4)
    got = decisions.size_hedge(df, "q", "fair_p_yes", 0.25, 0.5, 2.0)
    return got.select(*_IDS, "size_reject", "shares", r("intended_stake_usd", "intended_stake_usd"))


@query("P33_valid_candle", using="evals", sql="""
WITH c AS (SELECT *, CASE WHEN l_linenumber = 6 THEN 0 ELSE ret_5s_pct END AS o, ret_5s_pct + (l_suppkey % 3 - 1) AS h, ret_5s_pct - (l_partkey % 4 - 1) AS l, ret_5s_pct + 0.5 AS c FROM evals)
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN NOT (o > 0 AND h > 0 AND l > 0 AND c > 0) THEN 'not_positive' WHEN h < l THEN 'high_below_low'
  WHEN h < greatest(o, c) THEN 'high_below_body' WHEN l > least(o, c) THEN 'low_above_body' END AS candle_reject FROM c""")
def _(t):
    p = col("ret_5s_pct")
    df = t.evals.withColumns(
        {
            "open": F.when(col("l_linenumber") == 6, 0.0).otherwise(p), "high": p + (col("l_suppkey") % 3 - 1),
            "low": p - (col("l_partkey") % 4 - 1), "close": p + 0.5,
        }
    )
    return prices.valid_candle(df).select(*_IDS, "candle_reject")


@query("P34_is_fresh", using="evals", sql="""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 5 + 2 >= l_suppkey % 5 + 2 AND latency_ms <= 700) AS fresh FROM evals""")
def _(t):
    fresh = times.is_fresh(col("l_partkey") % 5, col("l_suppkey") % 5 + 2, col("latency_ms"), 2, 700)
    return t.evals.select(*_IDS, fresh.alias("fresh"))


@query("P35_exact_latency", using="ticks", sql="""
WITH a AS (SELECT seq, ((seq::UHUGEINT + 42 + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS a FROM ticks),
b AS (SELECT seq, ((xor(a, a >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS b FROM a),
c AS (SELECT seq, ((xor(b, b >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS c FROM b)
SELECT seq, [307, 1019, 441, 520][(xor(c, c >> 31) % 4)::INT + 1]::BIGINT AS latency_ms FROM c""")
def _(t):
    return t.ticks.select("seq", decisions.sample_latency(col("seq"), [307, 1019, 441, 520], 42).alias("latency_ms"))


@query("P35_sample_latency")
def _(t):
    return t.ticks.select(
        "seq", decisions.sample_latency(col("seq"), [307, 1019, 441, 520], 42).alias("latency_ms"),
        decisions.sample_latency(col("seq"), [307, 1019, 441, 520], 42, exact=False).alias("fast_latency_ms"),
    )


@query("P36_decision_time", using="ticks evals", sql="""
WITH s AS (SELECT variant AS scenario, CAST(quantile_disc(latency_ms, 0.5) AS BIGINT) AS l, 50 AS e FROM evals GROUP BY variant)
SELECT seq, scenario, ts_ms + l + e AS decision_ms FROM ticks CROSS JOIN s""")
def _(t):
    scenarios = t.evals.groupBy(col("variant").alias("scenario")).agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("latency_ms")
    ).withColumn("execution_latency_ms", F.lit(50))
    return times.decision_time(t.ticks.select("seq", "ts_ms"), scenarios, "ts_ms").select("seq", "scenario", "decision_ms")


@query("P37_error_class", sql="""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'HTTP status 429 ' WHEN 1 THEN 'HTTP status 503 ' WHEN 2 THEN 'Deadline ' WHEN 3 THEN 'TIMEOUT ' ELSE '' END || text AS e FROM documents)
SELECT doc_id, CASE WHEN contains(e, '429') THEN '429' WHEN contains(e, 'HTTP status 5') THEN '5xx' WHEN contains(lower(e), 'deadline') OR contains(lower(e), 'timeout') THEN 'deadline' ELSE 'other' END AS status FROM d""")
def _(t):
    head = F.get(F.array(*[F.lit(x) for x in ("HTTP status 429 ", "HTTP status 503 ", "Deadline ", "TIMEOUT ", "")]), (col("doc_id") % 5).cast("int"))
    return t.raw("documents").select("doc_id", text.error_class(F.concat(head, "text")).alias("status"))


@query("P38_aggressor", using="prints", sql="""
SELECT seq, aggressor AS side, CASE aggressor WHEN 'BUY' THEN 'SELL' WHEN 'SELL' THEN 'BUY' ELSE 'UNKNOWN' END AS inverted FROM prints""")
def _(t):
    raw = F.when(col("aggressor") != "UNKNOWN", F.concat(F.lit(" "), F.lower("aggressor")))
    return t.prints.select("seq", prices.aggressor(raw).alias("side"), prices.invert_aggressor(raw).alias("inverted"))


@query("P39_hold_cancel_exit", using="evals", sql=f"""
SELECT pair_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_linenumber > 1 AND move_persists >= 0.2 AND fill_toxic < 0.35) AS hold,
  (quoted AND (latency_ms >= 500 OR NOT ({_GATE_SQL}) OR fill_toxic >= 0.35)) AS cancel,
  (l_linenumber > 1 AND (latency_ms >= 900 OR fill_toxic >= 0.38 OR underreact_down >= 0.79 OR (pressure - fair_p_yes) * 100 <= -30 OR (pressure - fair_p_yes) * 100 >= 40)) AS exit_now FROM evals""")
def _(t):
    levels = {"max_hold_ms": 900, "toxicity_exit_min": 0.38, "down_probability_exit_min": 0.79, "stop_loss_pp": 30.0, "take_profit_pp": 40.0}
    q = col("l_linenumber") - 1
    return t.evals.select(
        *_IDS, decisions.hold(q, _CUTS).alias("hold"),
        decisions.cancel(col("quoted"), F.lit(500), col("latency_ms"), _CUTS).alias("cancel"),
        decisions.exit_now(q, F.lit(0), col("latency_ms"), col("fair_p_yes"), col("pressure"), col("underreact_down"), levels).alias("exit_now"),
    )

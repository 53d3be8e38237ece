"""Judge answers, state JSON, identities and the causality audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.functions.prices import unit

# Answer names, buckets and pressure levels of the judge's answer JSON.
PROBABILITY_ANSWERS = (
    "yes_pressure_5s", "no_pressure_5s", "move_persists", "underreact_up",
    "underreact_down", "fill_before_decay", "fill_toxic",
)
BUCKETS = (
    "UP_3_PLUS_TICKS", "UP_2_TICKS", "UP_1_TICK", "FLAT", "DOWN_1_TICK",
    "DOWN_2_TICKS", "DOWN_3_PLUS_TICKS",
)
BUCKET_FIELDS = ("up_3_plus", "up_2", "up_1", "flat", "down_1", "down_2", "down_3_plus")
PRESSURE_LEVELS = {
    "STRONG_DOWN": -1.0, "MILD_DOWN": -0.5, "NEUTRAL": 0.0, "MILD_UP": 0.5, "STRONG_UP": 1.0,
}
SUM_TOLERANCE = 0.02
FORBIDDEN_KEYS = ("outcome", "resolved_ts_ms")

_ANSWER = "STRUCT<type: STRING, noul: DOUBLE, probabilities: MAP<STRING, DOUBLE>, confidence: DOUBLE>"
# The answers read, as struct fields: a field access each instead of a map lookup.
ANSWERS_SCHEMA = (
    "answers STRUCT<"
    + ", ".join(f"{n}: {_ANSWER}" for n in (*PROBABILITY_ANSWERS, "fair_p_yes", "repricing_ticks", "pressure_5s"))
    + ">, usage STRUCT<input_tokens: BIGINT, output_tokens: BIGINT>, _corrupt_record STRING"
)


def _decoded(json: Column) -> Column:
    return F.from_json(json, ANSWERS_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _probability_error(answers: Column, name: str) -> Column:
    a = answers.getField(name)
    value = a.getField("noul")
    return (
        F.when(a.isNull(), F.lit(f"missing_answer:{name}"))
        .when(a.getField("type").isNotNull() & (a.getField("type") != "noul"), F.lit(f"answer_type:{name}"))
        .when(value.isNull(), F.lit(f"missing_field:{name}"))
        .when(~unit(value), F.lit(f"probability:{name}"))
    )


def _choice_error(answers: Column, name: str, levels, sum_to_one: bool) -> Column:
    a = answers.getField(name)
    probs = a.getField("probabilities")
    known = F.array(*[F.lit(x) for x in levels])
    values = F.map_values(probs)
    error = (
        F.when(a.isNull(), F.lit(f"missing_answer:{name}"))
        .when(a.getField("type").isNotNull() & (a.getField("type") != "choice"), F.lit(f"answer_type:{name}"))
        .when(probs.isNull(), F.lit(f"missing_field:{name}"))
        .when(F.size(F.array_except(F.map_keys(probs), known)) > 0, F.lit("unexpected_bucket"))
        .when(F.size(F.array_except(known, F.map_keys(probs))) > 0, F.lit("missing_bucket"))
        .when(F.exists(values, lambda x: ~F.coalesce(unit(x), F.lit(False))), F.lit("bucket_probability"))
    )
    if sum_to_one:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
        error = error.when(F.abs(total - 1.0) > SUM_TOLERANCE, F.lit("distribution_sum"))
    conf = a.getField("confidence")
    return error.when(conf.isNull(), F.lit(f"missing_field:{name}.confidence")).when(
        ~unit(conf), F.lit("confidence")
    )


def parse_signal(df: DataFrame, json: str) -> DataFrame:
    """Adds ``signal`` (struct) or ``signal_error`` (first rule broken)."""
    work = df.withColumn("_d", _decoded(F.col(json)))
    answers = F.col("_d.answers")
    error = F.when(F.col("_d._corrupt_record").isNotNull() | answers.isNull(), F.lit("json"))
    error = F.coalesce(error, _choice_error(answers, "repricing_ticks", BUCKETS, True))
    for name in PROBABILITY_ANSWERS:
        error = F.coalesce(error, _probability_error(answers, name))
    probs = answers.getField("repricing_ticks").getField("probabilities")
    signal = F.struct(
        *[answers.getField(n).getField("noul").alias(n) for n in PROBABILITY_ANSWERS],
        F.struct(
            *[probs[b].alias(f) for b, f in zip(BUCKETS, BUCKET_FIELDS, strict=True)]
        ).alias("repricing"),
        answers.getField("repricing_ticks").getField("confidence").alias("repricing_confidence"),
        (probs["UP_1_TICK"] + probs["UP_2_TICKS"] + probs["UP_3_PLUS_TICKS"]).alias("p_up"),
        F.coalesce(F.col("_d.usage.input_tokens"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.col("_d.usage.output_tokens"), F.lit(0)).alias("tokens_out"),
    )
    work = work.withColumn("signal_error", error)
    return work.withColumn("signal", F.when(F.col("signal_error").isNull(), signal)).drop("_d")


def parse_fair_value(df: DataFrame, json: str) -> DataFrame:
    """Adds ``fair_p_yes`` or ``fair_error``."""
    work = df.withColumn("_d", _decoded(F.col(json)))
    answers = F.col("_d.answers")
    error = F.when(F.col("_d._corrupt_record").isNotNull() | answers.isNull(), F.lit("json"))
    work = work.withColumn("fair_error", F.coalesce(error, _probability_error(answers, "fair_p_yes")))
    value = answers.getField("fair_p_yes").getField("noul")
    return work.withColumn("fair_p_yes", F.when(F.col("fair_error").isNull(), value)).drop("_d")


def parse_pressure(df: DataFrame, json: str) -> DataFrame:
    """Adds ``pressure`` (probabilities times levels), its confidence, or an error."""
    work = df.withColumn("_d", _decoded(F.col(json)))
    answers = F.col("_d.answers")
    error = F.when(F.col("_d._corrupt_record").isNotNull() | answers.isNull(), F.lit("json"))
    error = F.coalesce(error, _choice_error(answers, "pressure_5s", PRESSURE_LEVELS, False))
    probs = answers.getField("pressure_5s").getField("probabilities")
    value = sum((probs[k] * v for k, v in PRESSURE_LEVELS.items()), F.lit(0.0))
    ok = F.col("pressure_error").isNull()
    return work.withColumn("pressure_error", error).withColumns(
        {
            "pressure": F.when(ok, value),
            "pressure_confidence": F.when(ok, answers.getField("pressure_5s").getField("confidence")),
        }
    ).drop("_d")


# Feature columns read from the state JSON.
STATE_FEATURES = {
    "underlying": (
        "ret_5s_pct", "ret_1m_pct", "realized_vol_1m_pct", "distance_to_target_pct",
        "time_remaining_secs", "ofi_5s", "poly_ofi_5s", "perp_basis_pct",
    ),
    "quant": ("move_zscore_1s",),
}


def extract_features(df: DataFrame, json: str, quotes: str) -> DataFrame:
    """State JSON to analysis columns; absent numbers are 0.0, the spread has a fallback.

    ``quotes`` names the JSON object that holds the YES quotes (micro units).
    """
    get = lambda path: F.get_json_object(json, f"$.{path}").try_cast("double")
    cols = {}
    for group, names in STATE_FEATURES.items():
        for n in names:
            cols[n] = F.coalesce(get(f"{group}.{n}"), F.lit(0.0))
    gap = (get(f"{quotes}.yes_ask") - get(f"{quotes}.yes_bid")) / 1e6
    cols["spread"] = F.coalesce(get(f"{quotes}.spread"), gap, F.lit(0.0))
    return df.withColumns(cols)


def p_up_from_buckets(buckets_json: Column) -> Column:
    """P(up by a tick or more) from the stored bucket JSON; absent buckets count 0."""
    get = lambda f: F.coalesce(F.get_json_object(buckets_json, f"$.{f}").try_cast("double"), F.lit(0.0))
    return get("up_3_plus") + get("up_2") + get("up_1")


def _canonical(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.struct(*[_canonical(col.getField(f.name), f.dataType).alias(f.name) for f in fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _canonical(x, kind.elementType))
    return col


def state_hash(df: DataFrame, column: str) -> Column:
    """SHA-256 of the struct's JSON with every object's keys in order."""
    kind = df.schema[column].dataType
    text = F.to_json(_canonical(F.col(column), kind), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)


def pair_id(condition: Column, ts_ms: Column, digest: Column) -> Column:
    return F.concat_ws(":", condition, ts_ms.cast("string"), F.substring(digest, 1, 12))


def replay_pair_id(run: Column, namespace: Column, seq: Column) -> Column:
    number = F.lpad(seq.cast("string"), 6, "0")
    padded = F.when(F.length(seq.cast("string")) > 6, seq.cast("string")).otherwise(number)
    return F.when(namespace == "", F.concat_ws("-", run, padded)).otherwise(
        F.concat_ws("-", run, namespace, padded)
    )


def audit_causality(df: DataFrame, t_ms: str, inputs: str, json: str) -> DataFrame:
    """Adds ``verdict`` and its detail.

    ``inputs`` is an array of ``(name, ts_ms)``: the first one later than the state
    rejects it; otherwise a forbidden key at any depth of the JSON does.
    """
    late = F.get(F.filter(F.col(inputs), lambda x: x["ts_ms"] > F.col(t_ms)), F.lit(0))
    text = F.to_json(F.try_parse_json(json))
    field = F.lit(None).cast("string")
    for key in reversed(FORBIDDEN_KEYS):
        field = F.when(text.rlike(f'"{key}"\\s*:'), F.lit(key)).otherwise(field)
    work = df.withColumns({"_late": late, "forbidden_field": field})
    verdict = (
        F.when(F.col("_late").isNotNull(), "future_input")
        .when(F.col("forbidden_field").isNotNull(), "forbidden_field")
        .otherwise("ok")
    )
    return work.withColumns(
        {
            "verdict": verdict,
            "late_input": F.col("_late.name"),
            "late_input_ts_ms": F.col("_late.ts_ms"),
        }
    ).drop("_late")

"""Key joins: selection, overlay, priority match, resolution, memo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.functions.text import blank
from tapelab.operators import scan


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the selected ids; Catalyst broadcasts the ids when they are small."""
    return df.join(ids.select(key), key, "left_semi")


def missing_ids(wanted: DataFrame, have: DataFrame, key: str, texts: Sequence[str] = ()) -> DataFrame:
    """Wanted ids without a usable record: keys compare trimmed and lower-cased, and a
    record counts only when all its texts are non-blank."""
    good = have
    for c in texts:
        good = good.where(~blank(F.col(c)))
    norm = lambda c: F.lower(F.trim(c.cast("string")))
    seen = good.select(norm(F.col(key)).alias("_k"))
    return wanted.withColumn("_k", norm(F.col(key))).join(seen, "_k", "left_anti").drop("_k")


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Non-blank new value wins, else the old one, column by column."""
    new = patch.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = {}
    for c in cols:
        n = F.col(f"_n_{c}")
        out[c] = F.coalesce(F.when(~blank(n), n), F.col(c))
    return base.join(new, list(keys), "left").withColumns(out).drop(*[f"_n_{c}" for c in cols])


def overlay_group(base: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A patch row replaces the whole label group, nulls included."""
    new = patch.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = {c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols}
    return base.join(new, list(keys), "left").withColumns(out).drop("_hit", *[f"_n_{c}" for c in cols])


def match_priority(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[str], unique_key: str
) -> DataFrame:
    """Best match per left row: the keys in order, then ``unique_key`` if it names one row.

    Each key is an equi-join on normalised text and right candidates are reduced to the
    first record per key beforehand, so a frequent key cannot multiply rows.
    """
    norm = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    hits = None
    for rank, key in enumerate([*keys, unique_key]):
        cand = right.where(~blank(F.col(key))).groupBy(norm(key).alias("_k")).agg(
            F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("_n")
        )
        if key == unique_key:
            cand = cand.where(F.col("_n") == 1)
        got = left.where(~blank(F.col(key))).select(left_id, norm(key).alias("_k")).join(cand, "_k").select(
            left_id, right_id, F.lit(rank).alias("_rank"), F.lit(key).alias("matched_on")
        )
        hits = got if hits is None else hits.unionByName(got)
    best = hits.groupBy(left_id).agg(
        F.min(F.struct("_rank", right_id, "matched_on")).alias("_b")
    ).select(left_id, f"_b.{right_id}", "_b.matched_on")
    return left.join(best, left_id, "left")


def join_resolution(
    markets: DataFrame, resolutions: DataFrame, specs: DataFrame, allow_proxy_outcome: bool = False,
    allow_proxy_time: bool = True, order: Sequence[str] = ("condition_id",), outcome_exact: bool = True,
) -> DataFrame:
    """Outcome and settlement time of each market with provenance, or a skip reason.

    The outcome comes from the first record per condition; the time from that record, else
    from the spec's end as a proxy. Nothing is inferred from absence.
    """
    rec = resolutions.groupBy("condition_id").agg(
        F.min_by(
            F.struct("winning_outcome", "resolution_status", "resolved_ms"), F.struct(*order)
        ).alias("_r")
    ).select("condition_id", "_r.*")
    spec = specs.select("condition_id", "end_ms", F.upper("fidelity").alias("_spec_fidelity"))
    df = markets.join(rec, "condition_id", "left").join(spec, "condition_id", "left")
    said = F.lower(F.trim("winning_outcome"))
    outcome = F.when(F.lower("resolution_status") == "resolved",
                     F.when(said.isin("up", "yes"), "yes").when(said.isin("down", "no"), "no"))
    fidelity = F.coalesce("_spec_fidelity", F.upper("fidelity"))
    df = df.withColumns(
        {
            "_outcome": outcome,
            "_at": F.coalesce("resolved_ms", "end_ms"),
            "_time": F.when(F.col("resolved_ms").isNotNull(), "exact").otherwise("proxy"),
            "_fid": fidelity,
        }
    )
    exact = F.lit(outcome_exact)
    reason = (
        F.when(blank(F.col("condition_id")) | blank(F.col("market_id")), "unknown_condition")
        .when(~F.coalesce(F.col("_at") > 0, F.lit(False)), "missing_timestamp")
        .when(F.col("_outcome").isNull(), "missing_outcome")
        .when(exact & ~F.coalesce(F.col("_fid") == "EXACT", F.lit(False)), "unreliable_fidelity")
        .when(~exact & F.lit(not allow_proxy_outcome), "proxy_not_allowed")
        .when((F.col("_time") == "proxy") & F.lit(not allow_proxy_time), "proxy_not_allowed")
    )
    df = df.withColumn("skip_reason", reason)
    ok = F.col("skip_reason").isNull()
    return df.select(
        *markets.columns,
        F.when(ok, F.col("_outcome")).alias("resolution_outcome"),
        F.when(ok, F.col("_at")).alias("resolved_at_ms"),
        F.when(ok, F.lit("exact" if outcome_exact else "proxy")).alias("outcome_provenance"),
        F.when(ok, F.col("_time")).alias("time_provenance"),
        "skip_reason",
    )


def label_signals(signals: DataFrame, resolutions: DataFrame) -> DataFrame:
    return signals.join(resolutions.select("condition_id", "winning_outcome"), "condition_id", "left")


# The columns that identify a judged state.
MEMO_KEY = (
    "state_hash", "questions_hash", "model_id", "variant", "strategy_version", "prompt_version",
    "model_version", "question_schema_version", "question_document_sha256", "feature_builder_version",
    "normalization_version", "serialization_version",
)


def memo_join(
    states: DataFrame, cache: DataFrame, key: Sequence[str], live: bool, order: str, budget: int | None = None,
    tie: Sequence[str] = (), width: int = scan.KEYLESS_MS,
) -> DataFrame:
    """States with ``memo`` = hit, call, or over_budget; hits carry ``result``.

    Only cache rows of the same mode count. Repeats of a missing state share one call: the
    first state of a key is the call and the later ones reuse it.
    """
    known = cache.where(F.col("live") == F.lit(live)).groupBy(*key).agg(F.first("result").alias("result"))
    df = states.join(known.withColumn("_hit", F.lit(True)), list(key), "left")
    firsts = df.where(F.col("_hit").isNull()).groupBy(*key).agg(F.min(F.struct(order, *tie)).alias("_first"))
    firsts = firsts.withColumn("_order", F.col(f"_first.{order}"))
    ranked = scan.numbered(firsts, [], "_order", ("_first",), width, rn="_rank")
    df = df.join(ranked.select(*key, "_first", "_rank"), list(key), "left")
    within = F.lit(True) if budget is None else F.col("_rank") <= budget
    mine = F.struct(order, *tie) == F.col("_first")
    memo = (
        F.when(F.col("_hit"), "hit").when(~within, "over_budget").when(mine, "call").otherwise("reuse")
    )
    return df.withColumn("memo", memo).drop("_hit", "_first", "_rank")


def support_check(selected: DataFrame, tape: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """How many selected ids exist in the tape, per group."""
    there = tape.select(key).distinct().withColumn("_in", F.lit(1))
    return selected.join(there, key, "left").groupBy(*by).agg(
        F.count_distinct(key).alias("selected"),
        F.count_distinct(F.when(F.col("_in") == 1, F.col(key))).alias("supported"),
    )


def missing(requested: DataFrame, got: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(got.select(key), key, "left_anti")

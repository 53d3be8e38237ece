"""Books: messages parsed once, and blocks that do not grow with the distance of message ids."""

import pytest

from tapelab.operators import book
from tapelab.plans.catalog import corpus
from tapelab.plans.views import Tables
from tests.test_twins import SF

LEVELS = "token_id STRING, msg LONG, kind STRING, side STRING, price_micros LONG, quantity LONG, pos INT"


def test_messages_are_parsed_once(spark):
    plan = corpus._levels(Tables(spark, SF))._jdf.queryExecution().analyzed().toString()
    assert "from_json" not in plan


def _sparse(spark, step: int):
    rows = []
    for i in range(1, 40):
        token, snap = f"T{i % 2}", i % 5 == 0
        rows.append((token, i * step, "snapshot" if snap else "delta", "BID" if i % 3 else "ASK", 100 * (i % 7), i, 0))
        if snap:
            rows.append((token, i * step, "snapshot", None, None, None, -1))
    return spark.createDataFrame(rows, LEVELS)


@pytest.mark.parametrize("step", (1, 100_000))
def test_blocks_follow_the_messages_and_not_their_ids(spark, step):
    cover, _ = book._covered(_sparse(spark, step), "token_id", 100_000, 8)
    assert cover.where("level > 1").isEmpty() and cover.count() <= 39 * 30


def test_hashes_do_not_depend_on_the_distance_of_ids(spark):
    near, far = (
        {(r.token_id, r.msg // step): r.book_hash for r in book.book_hashes(_sparse(spark, step)).collect()} for step in (1, 1_000)
    )
    assert near == far and len(near) == 39

"""The streaming fold against the fold over all rows, in any order of files."""

import json
import random
from datetime import datetime, timedelta

import pytest

from corrello.operators.dedup import fold_repeats
from corrello.streaming.fold import current_folds, stream_folds

ITEM = "id string, author string, title string, body string, published_at timestamp, fetched_at timestamp"
LONG = "a body that says the same thing over and over " * 6


def posts(n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        fetched = start + timedelta(hours=7 * i + rng.randrange(5))
        published = fetched - timedelta(days=rng.choice((0, 1, 4, 6, 9)), hours=rng.randrange(20))
        body = rng.choice((None, "", "short", LONG + rng.choice("ab"), LONG + "c"))
        rows.append((f"i{rng.randrange(10**6):06d}{i}", rng.choice(("Ann", "ann", "bob", None, "[deleted]", "Unknown")), rng.choice((None, "", "Scam!", "scam", "Other one", f"Own {i}")), body, rng.choice((published, published, None)), fetched))
    rows.append(("none", "ann", "scam", LONG, None, None))
    return rows


def write(spark, rows, folder, files):
    for n, some in enumerate(rows[i::files] for i in range(files)):
        spark.createDataFrame(some, ITEM).coalesce(1).write.mode("append").json(f"{folder}/{n:02d}")


def run(spark, landing, at, **more):
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).json(f"{landing}/*")
    query = stream_folds(stream, f"{at}/folds", f"{at}/checkpoint", **more)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled"])
def test_stream_equals_batch_in_any_order(spark, tmp_path, order):
    rows = posts(90, 1)
    want = {r["id"]: r["dup_of"] for r in fold_repeats(spark.createDataFrame(rows, ITEM)).collect()}
    assert sum(v is not None for v in want.values()) > 10
    if order == "reversed":
        rows = rows[::-1]
    elif order == "shuffled":
        random.Random(2).shuffle(rows)
    size = len(rows) // 3 + 1
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    landing = f"{tmp_path}/landing"
    write(spark, parts[0], landing, 1)
    run(spark, landing, tmp_path)
    for n, part in enumerate(parts[1:], 1):  # stopped, and started again with more files
        spark.createDataFrame(part, ITEM).coalesce(1).write.json(f"{landing}/{n + 40}")
    run(spark, landing, tmp_path)
    got = {r["id"]: r["dup_of"] for r in current_folds(spark, f"{tmp_path}/folds").collect()}
    assert got == want


def test_timers_drop_what_no_longer_matters(spark, tmp_path):
    rows = [r for r in posts(200, 3) if r[5] is not None]
    want = {r["id"]: r["dup_of"] for r in fold_repeats(spark.createDataFrame(rows, ITEM)).collect()}
    landing = f"{tmp_path}/landing"
    for n in range(0, 200, 50):
        spark.createDataFrame(rows[n : n + 50], ITEM).coalesce(1).write.json(f"{landing}/{n:03d}")
    query = run(spark, landing, tmp_path, lateness="2 days", reach=10.0)
    assert {r["id"]: r["dup_of"] for r in current_folds(spark, f"{tmp_path}/folds").collect()} == want
    kept = query.lastProgress["stateOperators"][0]
    assert kept["numRowsDroppedByWatermark"] == 0
    held = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "posts").load()
    assert 0 < sum(len(json.loads(r["user_map_value"]["posts"])) for r in held.collect()) < 120


def test_nothing_yet(spark, tmp_path):
    assert current_folds(spark, f"{tmp_path}/none").count() == 0

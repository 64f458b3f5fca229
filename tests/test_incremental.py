"""Tables kept up over batches against the tables built anew."""

import os
import random
from datetime import datetime, timedelta

import pytest

from corrello.operators import state
from corrello.operators.components import connected_components
from corrello.operators.incremental import Classes, EdgeTables
from corrello.store import shared_dir

EDGE = "case_id string, type string, value string, seen_at timestamp"


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def random_edges(rng, cases, values):
    start = datetime(2024, 1, 1)
    return [(f"c{c}", rng.choice(("domain", "ip")), f"v{rng.choice((0, rng.randrange(values)))}", rng.choice((None, start + timedelta(hours=rng.randrange(900))))) for c in cases for _ in range(3)]


def test_edges_equal_a_rebuild_and_only_their_buckets_change(spark, tmp_path):
    rng = random.Random(1)
    tables = EdgeTables(spark, f"{tmp_path}/t", 64)
    assert tables.observables().count() == 0 and tables.apply(spark.createDataFrame([], EDGE)) == []
    batches = [random_edges(rng, range(0, 150), 300), random_edges(rng, range(150, 152), 300), random_edges(rng, range(140, 151), 300) + [(None, "ip", "x", None), ("c1", "ip", None, None)]]
    rows = []
    for n, batch in enumerate(batches):
        before = files(f"{tmp_path}/t/edges")
        rows += batch
        touched = tables.apply(spark.createDataFrame(batch, EDGE))
        after = files(f"{tmp_path}/t/edges")
        changed = {int(p.split("bucket=")[1].split("/")[0]) for p in set(before) ^ set(after)}
        assert changed <= set(touched)
        if n == 1:  # about a hundredth of the rows
            assert len(touched) <= 6 and len(changed) < 7
        whole = spark.createDataFrame(rows, EDGE).where("case_id is not null and value is not null")
        want = sorted(map(str, state.observable_table(whole).select(tables.observables().columns).collect()))
        assert sorted(map(str, tables.observables().collect())) == want
    tables.apply(spark.createDataFrame(batches[2], EDGE))  # run again: nothing changes
    assert sorted(map(str, tables.observables().collect())) == want


def test_withdrawn_cases_leave_no_trace(spark, tmp_path):
    rows = random_edges(random.Random(2), range(40), 30)
    tables = EdgeTables(spark, f"{tmp_path}/t", 8)
    tables.apply(spark.createDataFrame(rows, EDGE))
    tables.apply(spark.createDataFrame(rows[:6], EDGE), spark.createDataFrame([(f"c{i}",) for i in range(1, 40)], "case_id string"))
    left = spark.createDataFrame([r for r in rows if r[0] == "c0"], EDGE)
    assert sorted(map(str, tables.observables().collect())) == sorted(map(str, state.observable_table(left).select(tables.observables().columns).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_components_of_all_links(spark, tmp_path, seed):
    rng = random.Random(seed)
    classes = Classes(spark, f"{tmp_path}/c", 32)
    links = []
    for n, size in enumerate((60, 3, 25)):
        batch = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(size)] + [("n001", None), ("n002", "n002")]
        links += batch
        before = files(f"{tmp_path}/c/labels")
        touched = classes.link(spark.createDataFrame(batch, "a string, b string"))
        changed = {int(p.split("bucket=")[1].split("/")[0]) for p in set(before) ^ set(files(f"{tmp_path}/c/labels"))}
        assert changed <= set(touched) and (n != 1 or len(touched) <= 12)
        want = sorted(map(tuple, connected_components(spark.createDataFrame(links, "a string, b string")).collect()))
        assert sorted(map(tuple, classes.components().collect())) == want
    classes.link(spark.createDataFrame(links, "a string, b string"))  # run again
    assert sorted(map(tuple, classes.components().collect())) == want


def test_a_batch_stages_no_more_than_its_own_rows(spark, tmp_path):
    """What a touched bucket holds already is shuffled and written once, not staged as well."""
    shared = shared_dir(spark).removeprefix("file://")
    tables = EdgeTables(spark, f"{tmp_path}/t", 2)
    tables.apply(spark.createDataFrame(random_edges(random.Random(4), range(60), 90), EDGE))
    before = files(shared)
    batch = random_edges(random.Random(5), range(60, 62), 90)
    assert len(tables.apply(spark.createDataFrame(batch, EDGE))) == 2
    staged = sorted(set(files(shared)) - set(before))
    assert sum(spark.read.parquet(f"file://{p}").count() for p in staged) <= len(batch)

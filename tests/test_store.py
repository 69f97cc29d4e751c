"""The store against a dictionary, and the scenarios its contract names."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.model import DELETE, PUT, InvalidArgument, NotFound
from palimpsest.operators import resolve, runs
from palimpsest.store import Service, Store


def state(store, snapshot=None):
    return {r.k: r.v for r in store.state(snapshot).collect()}


def test_put_get_delete(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("key1", "value1")
    assert s.get("key1") == "value1" and s.get("key2") is None
    s.put("empty", "")
    assert s.get("empty") == ""
    s.delete("key1")
    s.delete("never")
    assert s.get("key1") is None
    with pytest.raises(NotFound):
        s["key1"]
    with pytest.raises(InvalidArgument):
        s.write([(PUT, "a", "1"), (7, "b", "2")])
    assert s.get("a") is None


def test_reopen_flush_compact_keep_the_state(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write([(PUT, f"key{i}", f"v{i}") for i in range(60)])
    s.flush()
    s.write([(PUT, f"key{i}", f"new{i}") for i in range(10)])
    s.flush()
    s.write([(DELETE, f"key{i}", "") for i in range(10, 20)])
    snapshot = s.snapshot()
    before = state(s)
    s.flush()
    s.write([(DELETE, "key0", ""), (PUT, "key12", "back")])
    s.flush()
    now = state(s)
    assert "key10" not in before and now["key12"] == "back" and "key0" not in now and len(now) == 50
    assert s.compact() and not s.compact()
    assert state(s) == now and state(s, snapshot) == before
    s.vacuum()
    again = Store(spark, str(tmp_path))
    assert state(again) == now and again.last_seq == s.last_seq
    assert [r.k for r in again.scan("key2", "key3").collect()] == ["key2"] + [f"key{i}" for i in range(20, 30)]
    got = {r.k: (r.found, r.v) for r in again.multi_get(spark.createDataFrame([("key1",), ("key0",)], "k string")).collect()}
    assert got == {"key1": (True, "new1"), "key0": (False, None)}


def test_service(spark, tmp_path):
    service = Service(Store(spark, str(tmp_path)))
    assert service.put("k", "v") == {"success": True, "error": ""}
    assert service.get("k") == {"found": True, "value": "v", "error": ""} and service.get("x")["error"] == "Key not found"
    assert service.delete("k")["success"] and not service.get("k")["found"]
    bad = service.put(None, "v")
    assert not bad["success"] and bad["error"]


def test_log_without_a_flush_survives(spark, tmp_path):
    Store(spark, str(tmp_path)).put("a", "1")
    assert Store(spark, str(tmp_path)).get("a") == "1"


def test_write_frame_takes_sequences_in_order(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write_frame(spark.range(2000).select(F.col("id").alias("pos"), F.lit(PUT).alias("op"), (F.col("id") % 7).cast("string").alias("k"), F.col("id").cast("string").alias("v")))
    assert s.last_seq == 2000 and state(s)["3"] == "1999" if 1999 % 7 == 3 else state(s)["4"] == "1999"


@pytest.mark.parametrize("seed", range(3))
def test_random_operations_against_a_dictionary(seed, spark):
    draw = random.Random(seed)
    log, model, states = [], {}, {}
    for seq in range(1, 200):
        key = f"k{draw.randrange(25)}"
        if draw.random() < 0.3:
            log.append((key, seq, DELETE, ""))
            model.pop(key, None)
        else:
            value = draw.choice(["", str(seq)])
            log.append((key, seq, PUT, value))
            model[key] = value
        states[seq] = dict(model)
    df = spark.createDataFrame(log, "k string, seq long, op int, v string").repartition(4)
    collect = lambda x: {r.k: r.v for r in x.collect()}
    assert collect(resolve.latest(df)) == model
    assert collect(resolve.latest(df, 77)) == states[77]
    assert collect(resolve.anti_state(df)) == model
    flushed = runs.flush(runs.generations(df, 30))
    assert collect(runs.compact(flushed)) == model
    kept = runs.compact(df, 100)
    assert collect(resolve.latest(kept)) == model and collect(resolve.latest(kept, 150)) == states[150] and collect(resolve.latest(kept, 100)) == states[100]


def test_tombstones_are_dropped_after_resolution_only(spark):
    df = spark.createDataFrame([("a", 1, PUT, "x"), ("a", 2, DELETE, "")], "k string, seq long, op int, v string")
    assert resolve.latest(df).count() == 0
    plan = resolve.latest(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate")  # the filter stands above


def test_snapshots_hold_for_every_user_of_the_folder(spark, tmp_path):
    writer, reader = Store(spark, str(tmp_path)), None
    writer.put("a", "1")
    reader = Store(spark, str(tmp_path))
    seen = reader.snapshot()
    writer.refresh()
    writer.put("a", "2")
    writer.delete("a")
    writer.flush()
    writer.compact(force=True)
    reader.refresh()
    assert reader.get("a", seen) == "1" and reader.get("a") is None
    reader.release(seen)
    other = Store(spark, str(tmp_path))
    assert other.snapshots == []
    writer.refresh()
    writer.compact(force=True)
    assert Store(spark, str(tmp_path)).versions().count() == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    one = Store(spark, str(tmp_path))
    one.put("a", "1")
    two = Store(spark, str(tmp_path))
    one.put("a", "2")
    with pytest.raises(InvalidArgument):
        two.put("a", "3")
    assert Store(spark, str(tmp_path)).get("a") == "2"


def test_what_a_client_is_told(spark, tmp_path):
    import time

    store = Store(spark, str(tmp_path))
    assert Service(store, is_leader=lambda: False).put("k", "v") == {"success": False, "error": "Not the leader"}
    assert Service(store).put(None, "v")["error"].startswith("Propose failed")
    slow = Service(store, timeout=0.05)
    slow.store = type("Slow", (), {"put": lambda self, k, v: time.sleep(0.5)})()
    assert slow.put("k", "v") == {"success": False, "error": "Timeout waiting for consensus"}


def test_cache_holds_pinned_blocks(spark):
    from palimpsest.operators import cache

    def run(*events):
        rows = [(i, "k" if len(e) < 2 else e[1], 1, e[0]) for i, e in enumerate(events)]
        got = cache.simulate(spark.createDataFrame(rows, "at int, k string, charge int, kind string"), 16).first()
        return got.hits, got.misses, got.evictions, got.charge

    # One key, so one shard, with room for one block.
    assert run(("get",), ("get",)) == (1, 1, 0, 1)
    assert run(("pin",), ("prune",), ("get",), ("release",)) == (1, 1, 0, 1)
    assert run(("pin",), ("erase",), ("get",), ("release",))[:2] == (0, 2)
    assert run(("pin",), ("erase",), ("release",)) == (0, 1, 0, 0)
    assert run(("get",), ("prune",), ("get",), ("erase",)) == (0, 2, 0, 0)

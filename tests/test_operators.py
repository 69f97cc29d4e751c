"""Edge cases of the operators, and the plans they must have."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.model import InvalidArgument
from palimpsest.operators import batches, lookup, manifest, ordered, replog, resolve, runs
from palimpsest.sources.tables import change_log


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_point_get_pushes_the_key_into_the_scan(spark, sf_dir):
    p = plan(lookup.point_get(change_log(spark, sf_dir), "17", 900))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in p and "PushedFilters: [IsNotNull(" in p


def test_resolution_has_one_shuffle_and_aggregates_before_it(spark, sf_dir):
    p = plan(resolve.latest(change_log(spark, sf_dir)))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_max_by" in p


def test_no_order_dependent_query_gathers_rows_in_one_task(spark, sf_dir):
    log = change_log(spark, sf_dir)
    for df in (resolve.internal_order(log, F.substring("k", 1, 2)), ordered.previous(log, F.floor(F.col("seq") / 100), F.col("seq"), F.col("seq"), "p")):
        for part in plan(df).split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in part[:400]  # only the table of one row a block


def test_ordered_helpers_against_plain_lists(spark):
    values = [(i, i * 7 % 13) for i in range(97)]
    df = spark.createDataFrame(values, "i long, v long").repartition(5)
    block = F.floor(F.col("i") / 10)
    total, want = 0, {}
    for i, v in values:
        total += v
        want[i] = (total, i + 1, values[i - 1][1] if i else None)
    out = ordered.running_sum(df, block, [F.col("i")], F.col("v"), "s")
    out = ordered.row_numbers(out, block, [F.col("i")], "n")
    out = ordered.previous(out, block, F.col("i"), F.col("v"), "p")
    assert {r.i: (r.s, r.n, r.p) for r in out.collect()} == want


def test_empty_logs(spark):
    log = spark.createDataFrame([], "k string, seq long, op int, v string")
    assert resolve.latest(log).count() == 0 and resolve.history(log).count() == 0
    got = lookup.point_get(log, "a").first()
    assert (got.found, got.deleted, got.v) == (False, False, None)
    entries = spark.createDataFrame([], "idx long, term long, op int, k string, v string")
    assert tuple(replog.tail(entries).first()) == (0, 0, 0)
    assert replog.matches(entries, 0, 0).first().ok and not replog.matches(entries, 1, 1).first().ok


def log_of(spark, terms):
    return spark.createDataFrame([(i, t, 1, f"k{i}", f"v{i}") for i, t in enumerate(terms, 1)], "idx long, term long, op int, k string, v string")


def test_log_ranges_and_truncation(spark):
    log = log_of(spark, [1, 1, 2])
    assert [r.idx for r in replog.get_range(log, 1, 3).orderBy("idx").collect()] == [1, 2]
    assert tuple(replog.tail(log).first()) == (3, 2, 3) and tuple(replog.tail(replog.truncate(log, 2)).first()) == (1, 1, 1)
    assert replog.entry(log, 9).count() == 0 and replog.compacted(log, 3).count() == 1
    for bad in ((0, 3), (2, 2)):
        with pytest.raises(InvalidArgument):
            replog.get_range(log, *bad)
    for bad in (0, 5, 99):
        with pytest.raises(InvalidArgument):
            replog.truncate(log, bad)
    assert replog.truncate(log, 4).count() == 3 and replog.get_range(log, 3, 5).count() == 1
    with pytest.raises(InvalidArgument):
        replog.get_range(log, 3, 6)
    more = lambda *idx: spark.createDataFrame([(i, 2) for i in idx], "idx long, term long")
    log = log.select("idx", "term")
    assert replog.append(log, more(4, 5)).count() == 5 and replog.append(log, more(4).filter("false")).count() == 3
    for bad in ((5,), (3, 4), (4, 6), (4, 4)):
        with pytest.raises(InvalidArgument):
            replog.append(log, more(*bad))


def brute_append(mine, request, current, committed):
    """A follower's log, a list of terms, after an append request."""
    term, prev, prev_term, new, leader_commit = request
    ok = term >= current and (prev == 0 or prev <= len(mine) and mine[prev - 1] == prev_term)
    if not ok:
        return mine, (False, max(term, current), committed)
    out = list(mine)
    for k, t in enumerate(new):
        if prev + k < len(out) and out[prev + k] != t:
            out = out[: prev + k]
        if prev + k >= len(out):
            out.append(t)
    return out, (True, max(term, current), max(committed, min(leader_commit, prev + len(new))))


def test_append_requests_against_plain_lists(spark):
    draw = random.Random(3)
    for _ in range(14):
        mine = sorted(draw.randint(1, 3) for _ in range(draw.randint(0, 5)))
        prev = draw.randint(0, 6)
        request = (draw.randint(2, 4), prev, mine[prev - 1] if 0 < prev <= len(mine) and draw.random() < 0.8 else 2, sorted(draw.randint(1, 4) for _ in range(draw.randint(0, 4))), draw.randint(0, 9))
        rows = spark.createDataFrame([(prev + k + 1, t) for k, t in enumerate(request[3])], "idx long, term long")
        log, answer = replog.follower_append(log_of(spark, mine).select("idx", "term"), rows, term=request[0], current_term=3, prev_idx=prev, prev_term=request[2], leader_commit=request[4], committed=1)
        want, said = brute_append(mine, request, 3, 1)
        assert [r.term for r in log.orderBy("idx").collect()] == want and tuple(answer.values()) == said, (mine, request)


def test_roles_against_a_fold(spark):
    draw = random.Random(4)
    events = [(n, at, draw.choice(("timeout", "won", "saw", "saw")), draw.randint(0, 12)) for n in range(4) for at in range(60)]
    got = {(r.node, r.at): (r.term, r.role) for r in replog.roles(spark.createDataFrame(events, "node int, at int, kind string, seen long")).collect()}
    for n in range(4):
        term, role = 0, "follower"
        for _, at, kind, seen in (e for e in events if e[0] == n):
            if kind == "timeout":
                term, role = term + 1, "candidate"
            elif kind == "won" and role == "candidate":
                role = "leader"
            elif kind == "saw" and seen > term:
                term, role = seen, "follower"
            assert got[n, at] == (term, role)


def test_a_given_vote_holds_in_its_term(spark):
    ask = spark.createDataFrame([(1, 5, 9, 2, 1, "v"), (2, 5, 9, 2, 2, "v"), (2, 5, 9, 2, 1, "w"), (3, 6, 9, 2, 1, "w"), (1, 5, 9, 2, 1, "x")], "cand int, term long, li long, lt long, arrival int, voter string")
    voters = spark.createDataFrame([("v", 5, 0, 0, 2), ("w", 5, 0, 0, 1), ("x", 5, 0, 0, 4)], "voter string, term long, li long, lt long, voted_for int")
    assert {(r.voter, r.cand) for r in replog.granted(ask, voters).collect()} == {("v", 2), ("w", 3)}


def test_repeated_versions_and_sizes_of_files_added_again(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 1), ("b", 1, 0)], "k string, seq long, op int")
    assert [tuple(r) for r in batches.repeated(log).collect()] == [("a", 1, 1, 2)]
    edits = spark.createDataFrame([(1, "add", 0, 7, 100), (2, "delete", 0, 7, None), (3, "add", 0, 7, 300)], "edit_no long, kind string, level int, number long, file_size long")
    assert [tuple(r) for r in manifest.levels(edits).collect()] == [(0, 1, 300)]


def test_shared_prefixes_in_bytes_of_any_length(spark):
    pairs = [("é" * 100, "é" * 70 + "x"), ("a", "b"), ("", "a"), ("same", "same"), ("日本x", "日本y"), ("日", "旦"), ("x" * 5000 + "a", "x" * 5000 + "b"), (None, "a")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", runs.shared_prefix(F.col("a"), F.col("b")).alias("n")).collect():
        x, y = (r.a or "").encode(), r.b.encode()
        assert r.n == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_key_blocks_grow_with_the_key(spark):
    keys = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    got = keys.select("k", ordered.key_blocks(keys, "k", rows=100).alias("b")).orderBy("k").collect()
    assert [r.b for r in got] == sorted(r.b for r in got) and 30 < len({r.b for r in got}) <= 50


@pytest.mark.parametrize("follower,leader,want", [
    ([1, 1], [1, 1, 2], [1, 1, 2]), ([], [1], [1]), ([1, 9, 9], [1, 2], [1, 2]), ([1, 2, 3], [1, 2], [1, 2, 3]),
])
def test_splicing(spark, follower, leader, want):
    got = replog.spliced(log_of(spark, follower), log_of(spark, leader)).orderBy("idx").collect()
    assert [r.term for r in got] == want


def test_commit_needs_a_majority_and_the_current_term(spark):
    log = log_of(spark, [1, 1, 2, 2])
    peers = lambda *m: spark.createDataFrame([(str(i), x) for i, x in enumerate(m)], "peer string, mi long")
    commit = lambda p, term, done=0: replog.commit_index(p, log, term, done).first().commit_index
    assert commit(peers(4, 3, 0), 2) == 3 and commit(peers(4, 2, 0), 2) == 0 and commit(peers(4, 2, 0), 1) == 2
    assert commit(peers(4), 2) == 4  # a cluster of one
    assert commit(peers(4, 4, 4, 0), 2) == 4 and commit(peers(4, 4, 0, 0), 2) == 0 and commit(peers(4, 3, 0), 2, 3) == 3


def test_progress_steps_back_after_failures(spark):
    acks = spark.createDataFrame([("a", 5, 1, 1), ("a", 9, 2, 0), ("a", 9, 3, 0), ("b", 4, 1, 0), ("c", 7, 5, 1), ("c", 6, 9, 1)], "peer string, sent long, at long, ok int")
    assert {r.peer: (r.match_index, r.next_index) for r in replog.progress(acks).collect()} == {"a": (5, 4), "b": (0, 1), "c": (7, 8)}


def test_live_files_may_come_back(spark):
    rows = [(1, "add", 0, 5), (2, "delete", 0, 5), (3, "add", 0, 5), (1, "add", 0, 6), (4, "delete", 0, 6), (4, "add", 1, 6)]
    edits = spark.createDataFrame(rows, "edit_no long, kind string, level int, number long").withColumn("file_size", F.lit(1).cast("long"))
    assert sorted(map(tuple, manifest.live_files(edits).collect())) == [(0, 5), (1, 6)]


def test_group_commit_and_block_cuts(spark):
    sizes = spark.createDataFrame([(i, s) for i, s in enumerate([5, 5, 1, 20, 1, 1])], "bid long, size long")
    assert [tuple(r) for r in batches.group_commit(sizes, 9).orderBy("grp").collect()] == [(0, 2, 10), (1, 2, 21), (2, 2, 2)]
    entries = spark.createDataFrame([(0, "a", 6), (0, "b", 6), (0, "c", 3), (1, "a", 50)], "run long, k string, size long")
    assert sorted(map(tuple, runs.block_cuts(entries, 10).collect())) == [(0, 0, 2, 12), (0, 1, 1, 3), (1, 0, 1, 50)]


def test_stream_into_store_and_restart(spark, sf_dir, tmp_path):
    from palimpsest.sources.tables import table
    from palimpsest.store import Store
    from palimpsest.streaming import apply

    source = tmp_path / "in"
    log = change_log(spark, sf_dir)
    want = {r.k: r.v for r in resolve.latest(log).collect()}
    log.filter("seq <= 500").coalesce(1).write.parquet(str(source))
    store = Store(spark, str(tmp_path / "store"))

    def go():
        stream = apply.versions_stream(spark, str(source), log.schema).select(F.col("seq").alias("pos"), "op", "k", "v")
        apply.into_store(stream, store, str(tmp_path / "checkpoint"))

    go()
    log.filter("seq > 500").coalesce(1).write.mode("append").parquet(str(source))
    go()
    go()
    assert {r.k: r.v for r in store.state().collect()} == want and store.last_seq == table(spark, sf_dir, "events").count()


def test_hot_keys_in_many_windows(spark):
    rows = [("hot", i, i % 3 > 0, str(i)) for i in range(1, 400)] + [(f"k{i % 5}", 400 + i, True, "") for i in range(40)]
    log = spark.createDataFrame([(k, s, int(o), v) for k, s, o, v in rows], "k string, seq long, op int, v string").repartition(3)
    by_key = {}
    for k, s, *_ in rows:
        by_key.setdefault(k, []).append(s)
    want = {(k, s): t for k, ss in by_key.items() for s, t in zip(ss, [*ss[1:], None])}
    assert {(r.k, r.seq): r.valid_to for r in resolve.history(log, 7).collect()} == want
    order = sorted(((k, -s) for k, s, *_ in rows))
    got = resolve.internal_order(log, F.substring("k", 1, 1), 7).orderBy("pos").collect()
    assert [(r.k, -r.seq) for r in got] == order and [r.pos for r in got] == list(range(1, len(rows) + 1))

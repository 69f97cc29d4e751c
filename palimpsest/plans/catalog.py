"""Every registered query of the store's operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import coding, hashing
from palimpsest.operators import batches, cache, lookup, manifest, replog, resolve, runs
from palimpsest.plans import oracle
from palimpsest.sources.tables import change_log, entry_term, hash_keys, ordered_keys, replicated_log, table
from palimpsest.streaming import apply

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.texts().items() if k in QUERIES}


def _every(width: int):
    return F.floor((F.col("seq") - 1) / width).cast("bigint")


def _blocks(width: int = 1_000_000, column: str = "idx"):
    return F.floor(F.col(column) / width)


def _op(df: DataFrame) -> DataFrame:
    return df.withColumn("op", F.col("op").cast("bigint"))


# -- version resolution and lookup ------------------------------------------------


@query
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(change_log(spark, sf_dir))


@query
def kv_snapshot(spark, sf_dir):
    return resolve.latest(change_log(spark, sf_dir), 5000)


@query
def kv_point_get(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return lookup.point_get(log, "17").unionByName(lookup.point_get(log, "-1")).unionByName(lookup.point_get(log, "17", 500).withColumn("k", F.lit("17@500")))


@query
def kv_multi_get(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    return lookup.multi_get(change_log(spark, sf_dir), wanted)


@query
def kv_range_scan(spark, sf_dir):
    return lookup.range_scan(change_log(spark, sf_dir), "10", "15").select("k", "v")


@query
def kv_predecessor(spark, sf_dir):
    return lookup.predecessor(change_log(spark, sf_dir), "15")


@query
def kv_bounds(spark, sf_dir):
    log = change_log(spark, sf_dir)
    return lookup.lower_bound(log, "15").crossJoin(lookup.last_key(log))


@query
def kv_neighbours(spark, sf_dir):
    return lookup.neighbours(change_log(spark, sf_dir))


@query
def kv_anti(spark, sf_dir):
    return resolve.anti_state(change_log(spark, sf_dir))


@query
def kv_semi(spark, sf_dir):
    return lookup.known_keys(change_log(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k")))


@query
def version_history(spark, sf_dir):
    return _op(resolve.history(change_log(spark, sf_dir)))


@query
def internal_order(spark, sf_dir):
    return _op(resolve.internal_order(change_log(spark, sf_dir)))


# -- batches and the write-ahead log ----------------------------------------------


def _batched(spark, sf_dir):
    ops = change_log(spark, sf_dir).withColumn("bid", _every(100))
    listed = F.sort_array(F.collect_list(F.struct("seq", "op", "k", "v")))
    return ops.groupBy("bid").agg(F.min("seq").alias("base_seq"), F.transform(listed, lambda x: F.struct(x["op"].alias("op"), x["k"].alias("k"), x["v"].alias("v"))).alias("ops"), F.count("*").alias("cnt"))


@query
def write_batch_header(spark, sf_dir):
    return batches.headers(change_log(spark, sf_dir), _every(100))


@query
def batch_insert(spark, sf_dir):
    return _op(batches.expand(_batched(spark, sf_dir)))


@query
def batch_append(spark, sf_dir):
    return _op(batches.concatenate(_batched(spark, sf_dir), "bid"))


@query
def batch_validate(spark, sf_dir):
    """Every seventh batch claims one record too many, every eleventh has an unknown tag."""
    faulty = _batched(spark, sf_dir).withColumn("cnt", F.when(F.col("bid") % 7 == 3, F.col("cnt") + 1).otherwise(F.col("cnt")))
    tagged = F.transform("ops", lambda o, i: F.when((F.col("bid") % 11 == 5) & (i == 0), o.withField("op", F.lit(9))).otherwise(o))
    return batches.validate(faulty.withColumn("ops", tagged))


@query
def wal_offsets(spark, sf_dir):
    return batches.frames(change_log(spark, sf_dir), _every(100))


@query
def wal_replay_max_seq(spark, sf_dir):
    """The log as read up to a short tail: whole frames count, their versions come back with their sequences."""
    log = change_log(spark, sf_dir)
    framed = batches.frames(log, _every(100))
    whole = framed.crossJoin(F.broadcast(framed.agg((F.max(F.col("off") + F.col("frame")) - 5).alias("size")))).filter("off + frame <= size").select("bid")
    return log.withColumn("bid", _every(100)).join(whole, "bid", "left_semi").agg(F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query
def group_commit(spark, sf_dir):
    sizes = batches.headers(change_log(spark, sf_dir), _every(100)).select("bid", F.col("rep_size").alias("size"))
    return batches.group_commit(sizes, 8192)


# -- runs --------------------------------------------------------------------------


@query
def flush_dedupe(spark, sf_dir):
    return _op(runs.flush(runs.generations(change_log(spark, sf_dir), 1000)).select("gen", "k", "op", "v"))


@query
def l0_probe_first_hit(spark, sf_dir):
    return runs.first_hit(runs.flush(runs.generations(change_log(spark, sf_dir), 1000)))


@query
def compact_l1(spark, sf_dir):
    return runs.compact(runs.flush(runs.generations(change_log(spark, sf_dir), 1000))).select("k", "v")


@query
def compact_retaining(spark, sf_dir):
    """Compaction that keeps what a snapshot at 9000 sees."""
    return _op(runs.compact(change_log(spark, sf_dir), 9000).select("k", "seq", "op", "v"))


@query
def run_stats(spark, sf_dir):
    return runs.run_stats(runs.generations(change_log(spark, sf_dir), 1000))


@query
def run_dump(spark, sf_dir):
    return runs.dump(runs.flush(runs.generations(change_log(spark, sf_dir), 1000)))


@query
def run_seek(spark, sf_dir):
    return _op(runs.seek(runs.flush(runs.generations(change_log(spark, sf_dir), 1000)), "14"))


@query
def entry_prefix(spark, sf_dir):
    return runs.entry_prefixes(ordered_keys(spark, sf_dir))


@query
def entry_prefix_wide(spark, sf_dir):
    """Long keys beyond ASCII: lengths are bytes."""
    return runs.entry_prefixes(ordered_keys(spark, sf_dir).select(F.concat(F.lit("ключ-é" * 12), "k").alias("k")))


@query
def block_cuts(spark, sf_dir):
    entries = runs.flush(runs.generations(change_log(spark, sf_dir), 1000)).select(F.col("gen").alias("run"), "k", runs.entry_bytes(F.col("k"), F.col("v")).alias("size"))
    return runs.block_cuts(entries, 1024)


@query
def run_offsets(spark, sf_dir):
    entries = resolve.latest(change_log(spark, sf_dir)).select("k", runs.entry_bytes(F.col("k"), F.col("v")).alias("size"))
    return runs.offsets(entries)


# -- manifest ----------------------------------------------------------------------


def _edits(spark, sf_dir):
    """A run of level 0 a thousand events; every fourth edit adds one of level 1; every eighth deletes the runs of level 0 before
    it, and the edit before that one of level 1."""
    n = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).cast("bigint").alias("n")).distinct()
    row = lambda df, kind, level, number, size=None: df.select(F.col("n").alias("edit_no"), F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), number.cast("bigint").alias("number"), (size if size is not None else F.lit(None)).cast("bigint").alias("file_size"))
    merged, adds0 = n.filter("n % 4 = 3"), n
    eighth = (F.floor(F.col("n") / 8) * 8 + 8).cast("bigint")
    dels = n.select(eighth.alias("n"), (F.col("n") + 10).alias("num")).join(n, "n", "left_semi")
    parts = [
        row(adds0, "add", 0, F.col("n") + 10, F.col("n") * 100 + 4096),
        row(merged, "add", 1, F.col("n") + 100, F.col("n") * 1000 + 8192),
        dels.select(F.col("n").alias("edit_no"), F.lit("delete").alias("kind"), F.lit(0).alias("level"), F.col("num").alias("number"), F.lit(None).cast("bigint").alias("file_size")),
        row(n.filter("n % 8 = 7"), "delete", 1, F.col("n") + 96),
        row(n, "log", None, F.col("n") + 2),
        row(n, "prev_log", None, F.col("n") + 1),
        row(n, "next_file", None, F.col("n") + 200),
        row(n, "last_seq", None, (F.col("n") + 1) * 1000 - F.when(F.col("n") == 5, 3000).otherwise(0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def manifest_live_files(spark, sf_dir):
    return manifest.live_files(_edits(spark, sf_dir))


@query
def manifest_counters(spark, sf_dir):
    return manifest.counters(_edits(spark, sf_dir))


@query
def manifest_levels(spark, sf_dir):
    return manifest.levels(_edits(spark, sf_dir))


@query
def logs_to_replay(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 1000) + 5).cast("bigint").alias("log_number")).distinct()
    return manifest.logs_to_replay(logs, _edits(spark, sf_dir))


# -- replicated log ----------------------------------------------------------------


@query
def raft_contiguity(spark, sf_dir):
    log = table(spark, sf_dir, "events").filter("event_type <> 'signup'").select((F.col("event_id") + 1).alias("idx"))
    return replog.gaps(log, _blocks())


@query
def log_entry(spark, sf_dir):
    return _op(replog.entry(replicated_log(spark, sf_dir), 321))


@query
def log_get_range(spark, sf_dir):
    return _op(replog.get_range(replicated_log(spark, sf_dir), 100, 200).drop("term"))


@query
def log_truncate(spark, sf_dir):
    return replog.tail(replog.truncate(replicated_log(spark, sf_dir), 777))


@query
def log_compact(spark, sf_dir):
    return replog.compacted(replicated_log(spark, sf_dir), 9900).select("idx", "term")


@query
def log_recover(spark, sf_dir):
    log = replicated_log(spark, sf_dir).withColumn("len", F.lit(20).cast("bigint") + F.octet_length("k") + F.octet_length("v"))
    from palimpsest.operators.ordered import running_sum

    placed = running_sum(log, _blocks(), [F.col("idx")], F.col("len"), "end").withColumn("off", F.col("end") - F.col("len"))
    return replog.recovered(placed, 100_000).agg(F.max("idx").alias("last_idx"), F.max("end").alias("bytes"))


@query
def log_matches(spark, sf_dir):
    log = replicated_log(spark, sf_dir)
    cases = [(0, 0), (2500, 1), (2501, 1), (10**12, 1)]
    out = None
    for i, t in cases:
        one = replog.matches(log, i, t).select(F.lit(i).cast("bigint").alias("prev_idx"), F.lit(t).cast("bigint").alias("prev_term"), "ok")
        out = one if out is None else out.unionByName(one)
    return out


def _counted(e):
    """The events with their number, ``n``."""
    return e.crossJoin(F.broadcast(e.agg((F.max("event_id") + 1).alias("n"))))


def _two_logs(spark, sf_dir):
    """The leader has nine tenths of the events as entries; the follower has 19 of 20, from six tenths on of a term of its own."""
    e = _counted(table(spark, sf_dir, "events"))
    leader = e.filter("event_id * 10 < n * 9").select((F.col("event_id") + 1).alias("idx"), entry_term(F.col("event_id")).alias("term"))
    follower = e.filter("event_id * 20 < n * 19").select((F.col("event_id") + 1).alias("idx"), F.when(F.expr("event_id * 10 < n * 6"), entry_term(F.col("event_id"))).otherwise(10**9).alias("term"))
    return follower, leader


@query
def raft_first_conflict(spark, sf_dir):
    return replog.first_conflict(*_two_logs(spark, sf_dir))


@query
def raft_conflict_truncate(spark, sf_dir):
    return replog.spliced(*_two_logs(spark, sf_dir))


@query
def follower_append(spark, sf_dir):
    """The follower takes the leader's entries from half of its log on: where its log ends after that, and what it answers."""
    follower, leader = _two_logs(spark, sf_dir)
    last = replog.last_index(leader)
    prev = last // 2
    prev_term = leader.filter(F.col("idx") == prev).first()
    log, answer = replog.follower_append(
        follower, leader.filter(F.col("idx") > prev), term=10**9 + 1, current_term=10**9, prev_idx=prev, prev_term=prev_term.term if prev_term else 0, leader_commit=last - 10, committed=prev // 2
    )
    found = log.groupBy("term").agg(F.count("*").alias("entries"), F.max("idx").alias("last_idx"))
    return found.select("term", "entries", "last_idx", F.lit(answer["success"]).alias("success"), F.lit(answer["commit_index"]).cast("bigint").alias("commit_index"), F.lit(answer["term"]).cast("bigint").alias("answer_term"))


@query
def raft_commit_index(spark, sf_dir):
    peers = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("peer")).agg((F.max("event_id") + 1).alias("mi"))
    log = replicated_log(spark, sf_dir)
    term = log.agg(F.max("term")).first()[0] or 0
    return replog.commit_index(peers, log, term)


@query
def vote_log_ok(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cand")).agg((F.max("event_id") + 1).alias("li"))
    return replog.votes(ends.withColumn("lt", entry_term(F.col("li") - 1)))


@query
def vote_granted(spark, sf_dir):
    """Users ask the peers (event types) whose events they have; each peer's own log ends at its 300th last event."""
    e = table(spark, sf_dir, "events")
    requests = e.groupBy(F.col("user_id").alias("cand"), F.col("event_type").alias("voter")).agg((F.max("event_id") + 1).alias("li"), F.min("event_id").alias("arrival"))
    requests = requests.withColumn("lt", entry_term(F.col("li") - 1)).withColumn("term", F.lit(5).cast("bigint") + F.col("cand") % 2)
    voters = e.groupBy(F.col("event_type").alias("voter")).agg((F.max("event_id") - 300).alias("li"))
    return replog.granted(requests, voters.withColumn("lt", entry_term(F.col("li") - 1)).withColumn("term", F.lit(5).cast("bigint")))


@query
def vote_kept(spark, sf_dir):
    """As vote_granted, but every voter has given its vote of term 5 to the least user that has asked any."""
    e = table(spark, sf_dir, "events")
    requests = e.groupBy(F.col("user_id").alias("cand"), F.col("event_type").alias("voter")).agg((F.max("event_id") + 1).alias("li"), F.min("event_id").alias("arrival"))
    requests = requests.withColumn("lt", entry_term(F.col("li") - 1)).withColumn("term", F.lit(5).cast("bigint"))
    voters = e.groupBy(F.col("event_type").alias("voter")).agg(F.lit(0).cast("bigint").alias("li"), F.min("user_id").alias("voted_for"))
    return replog.granted(requests, voters.withColumn("lt", F.lit(0).cast("bigint")).withColumn("term", F.lit(5).cast("bigint")))


@query
def role_transitions(spark, sf_dir):
    """Users as nodes: errors are timeouts, purchases won elections, other events messages of a term that grows with time."""
    kind = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "purchase", "won").otherwise("saw")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("at"), kind.alias("kind"), F.floor(F.col("event_id") / 700).cast("bigint").alias("seen"))
    return replog.roles(events)


@query
def apply_committed(spark, sf_dir):
    return replog.applied(replicated_log(spark, sf_dir), 7000)


@query
def append_requests(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    peers = _counted(e).filter("event_id * 100 < n * 99").groupBy(F.col("event_type").alias("peer")).agg((F.max("event_id") + 1).alias("m"))
    return replog.append_requests(peers, e.select((F.col("event_id") + 1).alias("idx")))


@query
def replication_progress(spark, sf_dir):
    acks = table(spark, sf_dir, "events").select(F.col("event_type").alias("peer"), (F.col("event_id") + 1).alias("sent"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 10 == 0, 0).otherwise(1).alias("ok"))
    return replog.progress(acks)


@query
def pending_answers(spark, sf_dir):
    pending = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("idx"))
    return replog.answered(pending, replicated_log(spark, sf_dir), 7000)


@query
def leader_append(spark, sf_dir):
    proposals = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("n"), F.lit(1).alias("op"), F.col("user_id").cast("string").alias("k"), F.col("event_type").alias("v"))
    return _op(replog.appended(replicated_log(spark, sf_dir), proposals, 77))


@query
def micro_batches(spark, sf_dir):
    return replog.micro_batches(table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("n")), 1000)


@query
def stream_apply(spark, sf_dir):
    """The change log as a stream, applied to keyed state until nothing is left."""
    events = table(spark, sf_dir, "events")
    stream = apply.versions_stream(spark, f"{sf_dir}/event[s].parquet", events.schema)  # a pattern: the table may be a file or a folder
    gone = F.col("event_type") == "error"
    versions = stream.select(F.col("user_id").cast("string").alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(gone, 0).otherwise(1).alias("op"), F.when(gone, "").otherwise(F.concat_ws(":", "event_type", "props")).alias("v"))
    return apply.apply_available(versions, apply.scratch(spark))


# -- kernels -----------------------------------------------------------------------


@query
def varint_len(spark, sf_dir):
    return change_log(spark, sf_dir).select("seq", coding.varint_length(F.col("seq")).alias("n"))


@query
def varint_bytes(spark, sf_dir):
    """Squares, and integers over the whole range up to 2^63."""
    log = change_log(spark, sf_dir)
    n = log.select((F.col("seq") * F.col("seq")).alias("n")).unionByName(log.select((F.col("seq") % 10_000 * 922_337_203_685_477 + F.col("seq")).alias("n"))).withColumn("bytes", coding.varint_hex(F.col("n")))
    return n.withColumn("back", coding.varint_value(F.col("bytes")))


@query
def fixed_le(spark, sf_dir):
    n = change_log(spark, sf_dir).select("seq", (F.col("seq") * 429_496).alias("wide"))
    return n.select("seq", coding.fixed_hex(F.col("seq"), 4).alias("f32"), coding.fixed_hex(F.col("wide"), 8).alias("f64"), coding.fixed_value(coding.fixed_hex(F.col("wide"), 8), 8).alias("back"))


@query
def length_prefixed(spark, sf_dir):
    return change_log(spark, sf_dir).select("seq", coding.prefixed_hex(F.col("v")).alias("slice"))


@query
def key_hash(spark, sf_dir):
    return hash_keys(spark, sf_dir).select("k", hashing.key_hash(F.col("k")).alias("h"))


def _filter_keys(spark, sf_dir):
    """The keys of a filter over all orders, and one row with its number of bits."""
    keys = hash_keys(spark, sf_dir).withColumn("h", hashing.key_hash(F.col("k")))
    return keys, keys.agg((F.floor((F.greatest(F.lit(hashing.FEWEST_BITS), F.count("*") * hashing.BITS_PER_KEY) + 7) / 8) * 8).cast("bigint").alias("bits"))


@query
def bloom_bits(spark, sf_dir):
    keys, bits = _filter_keys(spark, sf_dir)
    return keys.crossJoin(F.broadcast(bits)).select("k", F.posexplode(hashing.bloom_positions(F.col("h"), F.col("bits"))).alias("j", "bitpos")).withColumn("j", F.col("j").cast("bigint"))


@query
def bloom_probe(spark, sf_dir):
    """Keys not in the filter, and which of them it lets through; keys in the filter always pass."""
    keys, bits = _filter_keys(spark, sf_dir)
    set_bits = keys.crossJoin(F.broadcast(bits)).select(F.explode(hashing.bloom_positions(F.col("h"), F.col("bits"))).alias("bitpos")).distinct()
    asked = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7919 - 3).cast("string").alias("k")).distinct()
    probe = asked.crossJoin(F.broadcast(bits)).select("k", F.explode(hashing.bloom_positions(hashing.key_hash(F.col("k")), F.col("bits"))).alias("bitpos"))
    return probe.join(set_bits.withColumn("hit", F.lit(1)), "bitpos", "left").groupBy("k").agg(F.coalesce(F.min(F.coalesce("hit", F.lit(0))), F.lit(0)).cast("bigint").alias("may_match"))


def _bloom_groups(spark, sf_dir):
    """The order keys in groups of a few dozen, as a filter block has them."""
    keys = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 100).cast("bigint").alias("grp"), (F.col("o_orderkey") * 7919).cast("string").alias("k")).distinct()
    return keys.withColumn("h", hashing.key_hash(F.col("k")))


@query
def bloom_build(spark, sf_dir):
    """A filter for every group of order keys, as bytes."""
    return hashing.bloom_bytes(_bloom_groups(spark, sf_dir), ["grp"])


@query
def bloom_match(spark, sf_dir):
    """Customers' keys held against the bytes of the filter of their group: how many it lets through."""
    filters = hashing.bloom_bytes(_bloom_groups(spark, sf_dir), ["grp"])
    asked = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 100).cast("bigint").alias("grp"), (F.col("c_custkey") * 7919 - 3).cast("string").alias("k"))
    lets = asked.join(filters, "grp").select("grp", hashing.bloom_may_match(F.col("filter"), hashing.key_hash(F.col("k"))).alias("ok"))
    return lets.groupBy("grp").agg(F.count("*").alias("asked"), F.count_if("ok").alias("let_through"))


@query
def filter_groups(spark, sf_dir):
    """keys by the 2 KiB granule of the file offset of their entry's block, and the bits of each granule's filter."""
    entries = ordered_keys(spark, sf_dir).select("k", F.lit(64).cast("bigint").alias("size"))
    placed = runs.offsets(entries)
    granule = F.shiftright(F.col("off") - F.col("off") % 4096, 11)
    grouped = placed.groupBy(granule.alias("granule")).agg(F.count("*").alias("n_keys"))
    return grouped.withColumn("bits", F.floor((F.greatest(F.lit(64), F.col("n_keys") * 10) + 7) / 8).cast("bigint") * 8)


@query
def cache_shards(spark, sf_dir):
    h = hash_keys(spark, sf_dir).select(hashing.key_hash(F.col("k"), hashing.CACHE_SEED).alias("h"), F.octet_length("k").cast("bigint").alias("charge"))
    return h.groupBy(hashing.cache_shard(F.col("h")).cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.sum("charge").alias("charge"))


@query
def cache_lru(spark, sf_dir):
    """Hits and evictions of a cache of 48 blocks over the trace of users."""
    trace = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").cast("string").alias("k"), F.lit(1).alias("charge"))
    return cache.simulate(trace, 48)


@query
def arena_usage(spark, sf_dir):
    """Per generation, blocks of an arena if entries are placed densely: whole blocks, and large entries alone."""
    size = (coding.record_bytes(F.col("op"), F.col("k"), F.col("v")) + 8).alias("size")
    entries = runs.generations(change_log(spark, sf_dir), 1000).select("gen", size)
    alone = F.sum(F.when(F.col("size") > 1024, F.col("size") + 8).otherwise(0))
    dense = F.ceil(F.sum(F.when(F.col("size") <= 1024, F.col("size")).otherwise(0)) / 4096) * (4096 + 8)
    return entries.groupBy("gen").agg((alone + dense).cast("bigint").alias("bytes"))

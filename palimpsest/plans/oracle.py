"""DuckDB SQL for the registered queries, as an independent statement of what each returns."""

from __future__ import annotations

OPS = "ops as (select cast(user_id as varchar) k, event_id + 1 seq, cast(case when event_type = 'error' then 0 else 1 end as bigint) op, case when event_type = 'error' then '' else event_type || ':' || props end v from events)"
VER = "ver as (select *, row_number() over (partition by k order by seq desc) rn from ops)"
GEN = "g as (select *, cast(floor((seq - 1) / 1000.0) as bigint) gen from ops)"
L0 = "l0 as (select gen, k, op, v, seq from (select *, row_number() over (partition by gen, k order by seq desc) rn from g) t where rn = 1)"
LIVE = "live as (select k, v, seq from ver where rn = 1 and op = 1)"


def vl(n: str) -> str:
    return f"(case when {n} < 128 then 1 when {n} < 16384 then 2 when {n} < 2097152 then 3 when {n} < 268435456 then 4 else 5 end)"


REC = f"(1 + {vl('strlen(k)')} + strlen(k) + (case when op = 1 then {vl('strlen(v)')} + strlen(v) else 0 end))"
BID = "cast(floor((seq - 1) / 100.0) as bigint)"
ENTRY = f"(1 + {vl('strlen(k)')} + {vl('(strlen(v) + 1)')} + strlen(k) + strlen(v) + 1)"
EDITS = """n as (select distinct cast(floor(event_id / 1000.0) as bigint) n from events),
adds as (select 0 lvl, n + 10 num, n edit, n * 100 + 4096 size from n union all select 1, n + 100, n, n * 1000 + 8192 from n where n % 4 = 3),
dels as (select 0 lvl, n + 10 num, n // 8 * 8 + 8 edit from n where n // 8 * 8 + 8 in (select n from n) union all select 1, n + 96, n from n where n % 8 = 7),
kept as (select lvl, num, size from adds a where not exists (select 1 from dels d where d.lvl = a.lvl and d.num = a.num and d.edit >= a.edit))"""
TERM = "cast(floor(event_id / 2500.0) as bigint) + 1"
N = "(select max(event_id) + 1 from events)"
TWO = f"lead as (select event_id + 1 idx, {TERM} term from events where event_id * 10 < {N} * 9), fol as (select event_id + 1 idx, case when event_id * 10 < {N} * 6 then {TERM} else 1000000000 end term from events where event_id * 20 < {N} * 19)"
M32 = "4294967295::HUGEINT"


def _hash(keys: str, seed: int) -> str:
    """CTE ``hk(k, h)`` of ``ks(k)``; ASCII keys."""
    m = "3332679571::HUGEINT"
    mul = lambda x: f"((({x}) & {M32}) * {m}) & {M32}"
    step = mul("h + w")
    tail = "g + (case when length(k) % 4 > 0 then ascii(k[(length(k)//4)*4+1]) else 0 end) + (case when length(k) % 4 > 1 then ascii(k[(length(k)//4)*4+2]) * 256 else 0 end) + (case when length(k) % 4 > 2 then ascii(k[(length(k)//4)*4+3]) * 65536 else 0 end)"
    return f"""ks as ({keys}), a as (select k, list_reduce(list_concat([xor({seed}::HUGEINT, (length(k)::HUGEINT * {m}) & {M32})], list_transform(range(0, length(k)//4), lambda i: (ascii(k[4*i+1]) + ascii(k[4*i+2])*256 + ascii(k[4*i+3])*65536 + ascii(k[4*i+4])*16777216::HUGEINT)::HUGEINT)), lambda h, w: xor(({step}), ({step}) >> 16)) g from ks),
hk as (select k, cast(case when length(k) % 4 = 0 then g else xor(({mul(tail)}), ({mul(tail)}) >> 24) end as bigint) h from a)"""


KEYS = "select distinct cast(o_orderkey * 7919 as varchar) k from orders"
POSITIONS = "cast(((h + j * (cast(floor(h / 131072) as bigint) + (h % 131072) * 32768)) % 4294967296) % bits as bigint)"
BITS = "b as (select cast(floor((greatest(64, count(*) * 10) + 7) / 8) * 8 as bigint) bits from (" + KEYS + "))"
GROUPED = "select distinct cast(floor(o_orderkey / 100.0) as bigint) grp, cast(o_orderkey * 7919 as varchar) k from orders"
FILTERS = f"""j as (select unnest(range(0, 6)) j), g as ({GROUPED}), sized as (select grp, count(*) n_keys, cast(floor((greatest(64, count(*) * 10) + 7) / 8) * 8 as bigint) bits from g group by grp),
set_at as (select g.grp, bits, {POSITIONS} p from g join sized on sized.grp = g.grp join hk on hk.k = g.k cross join j), y as (select grp, p // 8 i, bit_or(cast(1 << (p % 8) as integer)) b from set_at group by 1, 2),
f as (select s.grp, s.n_keys, string_agg(printf('%02X', coalesce(y.b, 0)), '' order by z.i) || '06' "filter" from sized s join (select grp, unnest(range(0, bits // 8)) i from sized) z on z.grp = s.grp left join y on y.grp = s.grp and y.i = z.i group by 1, 2)"""
PROBES = "j as (select unnest(range(0, 6)) j)"


def texts() -> dict[str, str]:
    with_ops, with_ver = f"with {OPS}", f"with {OPS}, {VER}"
    with_l0 = f"with {OPS}, {GEN}, {L0}"
    frames = f"h as (select {BID} bid, cast(16 + sum({REC}) as bigint) frame from ops group by 1), f as (select bid, frame, cast(sum(frame) over (order by bid) - frame as bigint) off from h)"
    return {
        "kv_latest": f"{with_ver} select k, v, seq from ver where rn = 1 and op = 1",
        "kv_snapshot": f"with {OPS}, ver as (select *, row_number() over (partition by k order by seq desc) rn from ops where seq <= 5000) select k, v, seq from ver where rn = 1 and op = 1",
        "kv_point_get": f"{with_ops}, q as (select '17' k, 9223372036854775807 s, '17' label union all select '-1', 9223372036854775807, '-1' union all select '17', 500, '17@500'), r as (select label, arg_max(op, seq) op, arg_max(v, seq) v from q left join ops on ops.k = q.k and seq <= s group by label) select label k, coalesce(op = 1, false) found, coalesce(op = 0, false) deleted, case when op = 1 then v end v from r",
        "kv_multi_get": f"{with_ver}, req as (select distinct cast(c_custkey as varchar) k from customer) select req.k, coalesce(ver.op = 1, false) found, case when ver.op = 1 then ver.v end v from req left join ver on req.k = ver.k and ver.rn = 1",
        "kv_range_scan": f"{with_ver} select k, v from ver where rn = 1 and op = 1 and k >= '10' and k < '15'",
        "kv_predecessor": f"{with_ver} select max(k) pred from ver where rn = 1 and op = 1 and k < '15'",
        "kv_bounds": f"{with_ver}, {LIVE} select (select min(k) from live where k >= '15') lower, (select max(k) from live) \"last\"",
        "kv_neighbours": f"{with_ver}, {LIVE} select k, lag(k) over (order by k) prev, lead(k) over (order by k) \"next\" from live",
        "kv_anti": f"{with_ops}, l as (select k, max(seq) s from ops group by k) select p.k, p.v, p.seq from ops p join l on p.k = l.k and p.seq = l.s where p.op = 1",
        "kv_semi": f"{with_ops} select distinct k from ops where exists (select 1 from customer where cast(c_custkey as varchar) = ops.k)",
        "version_history": f"{with_ops} select k, seq, op, v, lead(seq) over (partition by k order by seq) valid_to from ops",
        "internal_order": f"{with_ops} select row_number() over (order by k, seq desc, op desc) pos, k, seq, op from ops",
        "write_batch_header": f"{with_ops} select {BID} bid, min(seq) base_seq, count(*) cnt, cast(12 + sum({REC}) as bigint) rep_size from ops group by 1",
        "batch_insert": f"{with_ops} select k, seq, op, v from ops",
        "batch_append": f"{with_ops} select k, seq, op, v from ops",
        "batch_validate": f"{with_ops} select {BID} bid, case when {BID} % 11 = 5 then 'unknown tag' when {BID} % 7 = 3 then 'wrong count' else 'OK' end status from ops group by 1",
        "wal_offsets": f"{with_ops}, {frames} select bid, frame, off from f",
        "wal_replay_max_seq": f"{with_ops}, {frames}, w as (select bid from f where off + frame <= (select max(off + frame) - 5 from f)) select max(seq) last_seq, count(*) n from ops where {BID} in (select bid from w)",
        "group_commit": f"with recursive {OPS}, b as (select {BID} bid, cast(12 + sum({REC}) as bigint) sz from ops group by 1), r as (select bid, cast(0 as bigint) grp, sz acc from b where bid = 0 union all select b.bid, case when r.acc > 8192 then r.grp + 1 else r.grp end, case when r.acc > 8192 then b.sz else r.acc + b.sz end from r join b on b.bid = r.bid + 1) select grp, count(*) n, cast(max(acc) as bigint) bytes from r group by grp",
        "flush_dedupe": f"{with_l0} select gen, k, op, v from l0",
        "l0_probe_first_hit": f"{with_l0}, h as (select *, row_number() over (partition by k order by gen desc) n, row_number() over (partition by k order by gen) o from l0) select a.k, a.v newest, a.op nop, b.v oldest, b.op oop from h a join h b on a.k = b.k where a.n = 1 and b.o = 1",
        "compact_l1": f"{with_l0}, m as (select *, row_number() over (partition by k order by gen desc) r from l0) select k, v from m where r = 1 and op = 1",
        "compact_retaining": f"{with_ops}, o as (select *, row_number() over (partition by k order by seq desc) r from ops where seq <= 9000) select k, seq, op, v from o where r = 1 and op = 1 union all select k, seq, op, v from ops where seq > 9000",
        "run_stats": f"{with_ops}, {GEN}, r as (select *, row_number() over (partition by gen, k order by seq desc) rn from g) select gen, count(*) versions, cast(sum(case when rn = 1 then 1 else 0 end) as bigint) entries, cast(sum(case when rn = 1 and op = 0 then 1 else 0 end) as bigint) tombstones, min(k) smallest, max(k) largest from r group by gen",
        "run_dump": f"{with_l0} select gen, k, true found, op = 0 deleted, case when op = 1 then v end v from l0",
        "run_seek": f"{with_l0} select gen, k, op, v from l0 where k >= '14'",
        "entry_prefix_wide": "with t as (select k, hex(encode(k)) x, cast(row_number() over (order by k) - 1 as bigint) i, lag(hex(encode(k))) over (order by k) p from (select distinct repeat('ключ-é', 12) || cast(o_orderkey as varchar) k from orders)) select k, i % 16 slot, cast(case when i % 16 = 0 or p is null then 0 else coalesce(list_max(list_filter(range(0, least(length(x), length(p)) // 2 + 1), lambda n: x[1:2 * n] = p[1:2 * n])), 0) end as bigint) shared from t",
        "entry_prefix": "with t as (select k, cast(row_number() over (order by k) - 1 as bigint) i, lag(k) over (order by k) p from (select distinct cast(o_orderkey as varchar) k from orders)) select k, i % 16 slot, cast(case when i % 16 = 0 or p is null then 0 else coalesce(list_max(list_filter(range(0, least(length(k), length(p)) + 1), lambda n: k[1:n] = p[1:n])), 0) end as bigint) shared from t",
        "block_cuts": f"with recursive {OPS}, {GEN}, {L0}, e as (select gen, row_number() over (partition by gen order by k) i, {ENTRY} sz from l0), r as (select gen, i, cast(0 as bigint) b, cast(sz as bigint) acc from e where i = 1 union all select e.gen, e.i, case when r.acc >= 1024 then r.b + 1 else r.b end, cast(case when r.acc >= 1024 then e.sz else r.acc + e.sz end as bigint) from r join e on e.gen = r.gen and e.i = r.i + 1) select gen run, b block, count(*) entries, cast(max(acc) as bigint) bytes from r group by gen, b",
        "run_offsets": f"{with_ver}, {LIVE}, e as (select k, cast({ENTRY} as bigint) size from live) select k, size, cast(sum(size) over (order by k) - size as bigint) off from e",
        "manifest_live_files": f"with {EDITS} select cast(lvl as bigint) lvl, num from kept",
        "manifest_counters": f"with {EDITS} select max(n) + 2 log, max(n) + 1 prev_log, max(n) + 200 next_file, max((n + 1) * 1000 - case when n = 5 then 3000 else 0 end) last_seq from n",
        "manifest_levels": f"with {EDITS} select cast(lvl as bigint) lvl, count(*) files, cast(sum(size) as bigint) bytes from kept group by lvl",
        "logs_to_replay": f"with {EDITS} select n + 5 log_number, n + 5 >= (select max(n) + 2 from n) replay from n",
        "raft_contiguity": "with l as (select event_id + 1 idx, lag(event_id + 1) over (order by event_id) p from events where event_type <> 'signup') select idx, p from l where p is not null and idx <> p + 1",
        "log_entry": f"{with_ops} select seq idx, cast(floor((seq - 1) / 2500.0) as bigint) + 1 term, op, k, v from ops where seq = 321",
        "log_get_range": f"{with_ops} select seq idx, op, k, v from ops where seq >= 100 and seq < 200",
        "log_truncate": f"select coalesce(max(event_id + 1), 0) last_idx, coalesce(arg_max({TERM}, event_id), 0) last_term, count(*) entries from events where event_id + 1 < 777",
        "log_compact": f"select event_id + 1 idx, {TERM} term from events where event_id + 1 >= 9900",
        "log_recover": f"{with_ops}, e as (select seq idx, cast(sum(20 + strlen(k) + strlen(v)) over (order by seq) as bigint) e from ops) select max(idx) last_idx, max(e) bytes from e where e <= 100000",
        "log_matches": f"with c as (select 0 prev_idx, 0 prev_term union all select 2500, 1 union all select 2501, 1 union all select 1000000000000, 1), l as (select event_id + 1 idx, {TERM} term from events) select cast(prev_idx as bigint) prev_idx, cast(prev_term as bigint) prev_term, prev_idx = 0 or coalesce(term = prev_term, false) ok from c left join l on idx = prev_idx",
        "raft_first_conflict": f"with {TWO} select min(f.idx) x from fol f join lead l on f.idx = l.idx where f.term <> l.term",
        "raft_conflict_truncate": f"with {TWO}, c as (select coalesce((select min(f.idx) from fol f join lead l on f.idx = l.idx where f.term <> l.term), (select coalesce(max(idx), 0) + 1 from fol)) x) select idx, term from fol where idx < (select x from c) union all select idx, term from lead where idx >= (select x from c)",
        "follower_append": f"with {TWO}, z as (select max(idx) last, max(idx) // 2 prev from lead), c as (select min(l.idx) x from lead l left join fol f on f.idx = l.idx where l.idx > (select prev from z) and (f.term is null or f.term <> l.term)), r as (select idx, term from fol where idx < coalesce((select x from c), 9e18) union all select idx, term from lead where idx >= (select x from c)) select term, count(*) entries, max(idx) last_idx, true success, cast((select last - 10 from z) as bigint) commit_index, cast(1000000001 as bigint) answer_term from r group by term",
        "vote_kept": "with q as (select user_id cand, event_type voter, min(user_id) over (partition by event_type) vf from events) select voter, min(cand) cand from q where cand = vf group by voter",
        "role_transitions": "with recursive e as (select user_id node, event_id \"at\", case when event_type = 'error' then 'timeout' when event_type = 'purchase' then 'won' else 'saw' end kind, cast(floor(event_id / 700.0) as bigint) seen, row_number() over (partition by user_id order by event_id) i from events), r as (select node, cast(0 as bigint) i, cast(null as bigint) \"at\", cast('' as varchar) kind, cast(0 as bigint) term, 'follower' role from (select distinct node from e) union all select e.node, e.i, e.\"at\", e.kind, case when e.kind = 'timeout' then r.term + 1 when e.kind = 'saw' and e.seen > r.term then e.seen else r.term end, case when e.kind = 'timeout' then 'candidate' when e.kind = 'saw' and e.seen > r.term then 'follower' when e.kind = 'won' and r.role = 'candidate' then 'leader' else r.role end from r join e on e.node = r.node and e.i = r.i + 1) select node, \"at\", kind, term, role from r where i > 0",
        "raft_commit_index": f"with m as (select event_type peer, max(event_id + 1) mi from events group by 1), r as (select mi, row_number() over (order by mi desc) n, count(*) over () c from m), a as (select max(mi) i from r where n >= cast(floor(c / 2.0) as int) + 1) select cast(coalesce((select max(event_id + 1) from events where event_id + 1 = (select i from a) and {TERM} = (select max({TERM}) from events)), 0) as bigint) commit_index",
        "vote_log_ok": f"with c as (select user_id cand, max(event_id + 1) li, max({TERM}) lt from events group by 1), a as (select c.cand, case when c.lt > v.lt or (c.lt = v.lt and c.li >= v.li) then 1 else 0 end ok from c cross join c v) select cand, cast(sum(ok) as bigint) votes, cast(case when sum(ok) >= cast(floor(count(*) / 2.0) as int) + 1 then 1 else 0 end as bigint) elected from a group by cand",
        "vote_granted": f"with r as (select user_id cand, event_type voter, max(event_id) li0, min(event_id) arrival from events group by 1, 2), q as (select cand, voter, arrival, li0 + 1 li, cast(floor(li0 / 2500.0) as bigint) + 1 lt, 5 + cand % 2 term from r), v as (select event_type voter, max(event_id) - 300 li from events group by 1), w as (select voter, li, cast(floor((li - 1) / 2500.0) as bigint) + 1 lt from v), ok as (select q.* from q join w on q.voter = w.voter where q.term >= 5 and (q.lt > w.lt or (q.lt = w.lt and q.li >= w.li))), t as (select *, max(term) over (partition by voter) mt from ok) select voter, arg_min(cand, arrival) cand from t where term = mt group by voter",
        "apply_committed": f"with {OPS}, r as (select *, row_number() over (partition by k order by seq desc) rn from ops where seq <= 7000) select k, v, seq idx from r where rn = 1 and op = 1",
        "append_requests": "with peers as (select event_type peer, max(event_id + 1) m from events where event_id * 100 < (select max(event_id) + 1 from events) * 99 group by 1), log as (select event_id + 1 idx from events) select peer, m prev_idx, count(idx) n_entries, max(idx) last_idx from peers left join log on idx >= m + 1 group by peer, m",
        "replication_progress": "with a as (select event_type peer, event_id seen, event_id + 1 sent, event_id % 10 <> 0 ok from events), m as (select peer, coalesce(max(case when ok then sent end), 0) mi, coalesce(max(case when ok then seen end), -1) t from a group by peer) select m.peer, mi match_index, greatest(1, mi + 1 - (select count(*) from a where a.peer = m.peer and not ok and seen > t)) next_index from m",
        "pending_answers": "select event_id + 1 idx, event_id + 1 <= 7000 applied from events",
        "leader_append": "select (select max(event_id + 1) from events) + event_id + 1 idx, cast(77 as bigint) term, cast(1 as bigint) op, cast(user_id as varchar) k, event_type v from events",
        "micro_batches": "select cast(floor(event_id / 1000.0) as bigint) batch, min(event_id + 1) \"first\", max(event_id + 1) \"last\", count(*) n from events group by 1",
        "stream_apply": f"{with_ver} select k, v, seq from ver where rn = 1 and op = 1",
        "varint_len": f"select event_id + 1 seq, cast({vl('(event_id + 1)')} as bigint) n from events",
        "varint_bytes": "with t as (select (event_id + 1) * (event_id + 1) n from events union all select (event_id + 1) % 10000 * 922337203685477 + event_id + 1 from events), s as (select n, greatest(1, cast(ceil(length(ltrim(bin(n), '0')) / 7.0) as integer)) size from t) select n, list_aggregate(list_transform(range(0, size), lambda i: printf('%02X', (n >> (7 * i)) % 128 + case when i < size - 1 then 128 else 0 end)), 'string_agg', '') bytes, n back from s",
        "fixed_le": "with t as (select event_id + 1 seq, (event_id + 1) * 429496 wide from events) select seq, list_aggregate(list_transform(range(0, 4), lambda i: printf('%02X', (seq >> (8 * i)) % 256)), 'string_agg', '') f32, list_aggregate(list_transform(range(0, 8), lambda i: printf('%02X', (wide >> (8 * i)) % 256)), 'string_agg', '') f64, wide back from t",
        "length_prefixed": f"{with_ops} select seq, (case when strlen(v) < 128 then printf('%02X', strlen(v)) else printf('%02X%02X', strlen(v) % 128 + 128, strlen(v) // 128) end) || hex(v) slice from ops",
        "key_hash": f"with {_hash(KEYS, 0xBC9F1D34)} select k, h from hk",
        "bloom_bits": f"with {_hash(KEYS, 0xBC9F1D34)}, {BITS}, {PROBES} select k, j, {POSITIONS} bitpos from hk cross join j cross join b",
        "bloom_probe": f"with {_hash(KEYS + ' union select distinct cast(c_custkey * 7919 - 3 as varchar) from customer', 0xBC9F1D34)}, {BITS}, {PROBES}, i as ({KEYS}), asked as (select distinct cast(c_custkey * 7919 - 3 as varchar) k from customer), s as (select distinct {POSITIONS} p from hk cross join j cross join b where k in (select k from i)), q as (select k, {POSITIONS} p from hk cross join j cross join b where k in (select k from asked)) select q.k, cast(min(case when s.p is null then 0 else 1 end) as bigint) may_match from q left join s on q.p = s.p group by q.k",
        "bloom_build": f"with {_hash('select distinct k from (' + GROUPED + ')', 0xBC9F1D34)}, {FILTERS} select grp, n_keys, \"filter\" from f",
        "bloom_match": f"with {_hash('select distinct k from (' + GROUPED + ') union select distinct cast(c_custkey * 7919 - 3 as varchar) from customer', 0xBC9F1D34)}, {FILTERS}, q as (select c.grp, c.k, s.bits from (select cast(floor(c_custkey / 100.0) as bigint) grp, cast(c_custkey * 7919 - 3 as varchar) k from customer) c join sized s on s.grp = c.grp), p as (select q.grp, q.k, {POSITIONS} p from q join hk on hk.k = q.k cross join j), m as (select p.grp, p.k, min(case when x.p is null then 0 else 1 end) ok from p left join (select distinct grp, p from set_at) x on x.grp = p.grp and x.p = p.p group by p.grp, p.k) select grp, count(*) asked, cast(sum(ok) as bigint) let_through from m group by grp",
        "filter_groups": "with t as (select cast(64 * (row_number() over (order by k) - 1) as bigint) off from (select distinct cast(o_orderkey as varchar) k from orders)), g as (select (off - off % 4096) // 2048 granule, count(*) n_keys from t group by 1) select granule, n_keys, ((greatest(64, n_keys * 10) + 7) // 8) * 8 bits from g",
        "cache_shards": f"with {_hash(KEYS, 0)} select cast(floor(h / 268435456) as bigint) shard, count(*) n, cast(sum(length(k)) as bigint) charge from hk group by 1",
        "cache_lru": f"with {_hash('select distinct cast(user_id as varchar) k from events', 0)}, t as (select event_id seen, cast(user_id as varchar) k, cast(floor(h / 268435456) as bigint) shard, lag(event_id) over (partition by user_id order by event_id) prev from events join hk on hk.k = cast(user_id as varchar)), d as (select t.shard, t.seen, count(distinct b.k) between_keys, any_value(t.prev) prev from t left join t b on b.shard = t.shard and b.seen > t.prev and b.seen < t.seen group by t.shard, t.seen), c as (select shard, cast(sum(case when prev is not null and between_keys < 3 then 1 else 0 end) as bigint) hits, count(*) n from d group by shard), u as (select shard, least(3, count(distinct k)) held from t group by shard) select c.shard, hits, n - hits misses, n - hits - held evictions, held charge from c join u on u.shard = c.shard",
        "arena_usage": f"with {OPS}, {GEN}, s as (select gen, {REC} + 8 size from g) select gen, cast(sum(case when size > 1024 then size + 8 else 0 end) + ceil(sum(case when size <= 1024 then size else 0 end) / 4096.0) * 4104 as bigint) bytes from s group by gen",
    }

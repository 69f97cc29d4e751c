"""The replicated log: contiguity, matching, conflict truncation, quorum commit, votes and apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import InvalidArgument
from palimpsest.operators.ordered import previous, running_sum
from palimpsest.operators.resolve import latest


def majority(peers: Column) -> Column:
    """F8: the smallest majority of a cluster of ``peers`` nodes, one included."""
    return F.floor(peers / 2).cast("bigint") + 1


def gaps(log: DataFrame, block: Column) -> DataFrame:
    """(idx, p): entries whose index doesn't follow the entry before."""
    return previous(log.select("idx"), block, F.col("idx"), F.col("idx"), "p").filter("p is not null and idx <> p + 1")


def entry(log: DataFrame, index: int) -> DataFrame:
    """The entry at ``index``; no row if it is out of range."""
    return log.filter(F.col("idx") == index)


def last_index(log: DataFrame) -> int:
    """The index of the last entry; 0 of an empty log.  One row is read."""
    return log.agg(F.max("idx")).first()[0] or 0


def get_range(log: DataFrame, start: int, end: int) -> DataFrame:
    """Entries start <= idx < end; the bounds reach the scan.  The end may lie no more than one beyond the place of the next entry."""
    if start < 1 or end <= start or end > last_index(log) + 2:
        raise InvalidArgument(f"range [{start}, {end})")
    return log.filter((F.col("idx") >= start) & (F.col("idx") < end))


def truncate(log: DataFrame, index: int) -> DataFrame:
    """The log before ``index``, which is an entry's or the next one's."""
    if index < 1 or index > last_index(log) + 1:
        raise InvalidArgument(f"index {index}")
    return log.filter(F.col("idx") < index)


def compacted(log: DataFrame, index: int) -> DataFrame:
    """The log from ``index`` on."""
    return log.filter(F.col("idx") >= index)


def tail(log: DataFrame) -> DataFrame:
    """A2: one row (last_idx, last_term, entries); zeros for an empty log."""
    return log.agg(F.coalesce(F.max("idx"), F.lit(0).cast("bigint")).alias("last_idx"), F.coalesce(F.max_by("term", "idx"), F.lit(0).cast("bigint")).alias("last_term"), F.count("*").alias("entries"))


def recovered(framed: DataFrame, file_size: int) -> DataFrame:
    """The entries that end within the file; the first that doesn't, and all after it, are a partial tail."""
    return framed.filter(F.col("off") + F.col("len") <= file_size)


def matches(follower: DataFrame, prev_idx: int, prev_term: int) -> DataFrame:
    """One row (ok): whether the follower holds ``prev_term`` at ``prev_idx``; index 0 always matches."""
    held = follower.filter(F.col("idx") == prev_idx).agg(F.max("term").alias("t"))
    return held.select((F.lit(prev_idx == 0) | F.coalesce(F.col("t") == prev_term, F.lit(False))).alias("ok"))


def first_conflict(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """One row (x): the first index that both hold with different terms, null if none."""
    mine = follower.select("idx", F.col("term").alias("mine"))
    return mine.join(leader.select("idx", "term"), "idx").filter(F.col("mine") != F.col("term")).agg(F.min("idx").alias("x"))


def spliced(follower: DataFrame, leader: DataFrame) -> DataFrame:
    """The follower's log after it took the leader's: cut at the first conflict, else at its end, and gone on from the leader's."""
    last = follower.agg(F.max("idx").alias("last"))
    cut = first_conflict(follower, leader).crossJoin(last).select(F.coalesce("x", F.coalesce("last", F.lit(0)) + 1).alias("x"))
    keep = follower.select("idx", "term").crossJoin(F.broadcast(cut)).filter(F.col("idx") < F.col("x"))
    rest = leader.select("idx", "term").crossJoin(F.broadcast(cut)).filter(F.col("idx") >= F.col("x"))
    return keep.unionByName(rest).select("idx", "term")


def follower_append(follower: DataFrame, entries: DataFrame, *, term: int, current_term: int, prev_idx: int, prev_term: int, leader_commit: int, committed: int) -> tuple[DataFrame, dict]:
    """What a follower does with an append request: (its log after it, the answer).

    A request of an older term, or one whose previous entry the follower does not hold, changes nothing and fails.  Else
    entries that the follower has stay, it is cut at the first of another term, and takes the rest; what lies beyond the
    request stays where nothing conflicts.  The commit index goes to the leader's, no further than the request's last entry, and never back.
    """
    answer = {"success": False, "term": max(term, current_term), "commit_index": committed}
    if term < current_term or not matches(follower, prev_idx, prev_term).first().ok:
        return follower, answer
    mine = follower.select("idx", F.col("term").alias("mine"))
    new = entries.join(mine, "idx", "left").filter(F.col("mine").isNull() | (F.col("mine") != F.col("term")))
    lacks, count = new.agg(F.min("idx")).first()[0], entries.count()
    answer |= {"success": True, "commit_index": max(committed, min(leader_commit, prev_idx + count))}
    if lacks is None:
        return follower, answer
    return truncate(follower, lacks).unionByName(entries.filter(F.col("idx") >= lacks)), answer


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with ``entries``, which must go on from its end without a gap or a repeat."""
    low, high, n, distinct = entries.agg(F.min("idx"), F.max("idx"), F.count("*"), F.count_distinct("idx")).first()
    if n and (low != last_index(log) + 1 or high - low + 1 != n or distinct != n):
        raise InvalidArgument(f"entries {low} to {high} after {last_index(log)}")
    return log.unionByName(entries)


def commit_index(peers: DataFrame, log: DataFrame, term: int, committed: int = 0) -> DataFrame:
    """A3: (commit_index): the greatest index that a majority of ``peers(peer, mi)`` holds, if its entry is of the current
    term and beyond ``committed``; else ``committed``."""
    n = F.size("m")
    agreed = peers.agg(F.sort_array(F.collect_list("mi"), asc=False).alias("m")).select(F.get("m", majority(n).cast("int") - 1).alias("idx"))
    of = agreed.join(log.select("idx", "term"), "idx", "left").agg(F.max(F.when((F.col("term") == term) & (F.col("idx") > committed), F.col("idx"))).alias("i"))
    return of.select(F.coalesce("i", F.lit(committed)).cast("bigint").alias("commit_index"))


def up_to_date(term: Column, index: Column, other_term: Column, other_index: Column) -> Column:
    """whether a log that ends at (term, index) is as new as one that ends at (other_term, other_index)."""
    return F.struct(term, index) >= F.struct(other_term, other_index)


def votes(logs: DataFrame) -> DataFrame:
    """(cand, votes, elected): every node of ``logs(cand, li, lt)`` asks all, itself included, for their vote.

    A voter grants it to a log as new as its own, so the votes are the nodes whose log isn't newer: a running count over
    the distinct log ends, not a comparison of all pairs.
    """
    ends = logs.groupBy("lt", "li").agg(F.count("*").alias("n"))
    ranked = running_sum(ends, F.col("lt"), [F.col("li")], F.col("n"), "votes").drop("n")
    total = logs.agg(F.count("*").alias("total"))
    counted = logs.join(ranked, ["lt", "li"]).crossJoin(F.broadcast(total))
    return counted.select("cand", F.col("votes").cast("bigint").alias("votes"), (F.col("votes") >= majority(F.col("total"))).cast("bigint").alias("elected"))


def granted(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """(voter, cand): whom each voter grants its vote: the first to ask, of those at a term as new and with a log as new
    as its own.  ``requests(cand, term, li, lt, arrival, voter)``, ``voters(voter, term, li, lt)``.  With a column
    ``voted_for``, a vote given in the voter's term holds: in that term only the same candidate gets it again."""
    before = F.col("voted_for") if "voted_for" in voters.columns else F.lit(None)
    v = voters.select("voter", F.col("term").alias("vt"), F.col("li").alias("vli"), F.col("lt").alias("vlt"), before.alias("vf"))
    free = (F.col("term") > F.col("vt")) | F.col("vf").isNull() | (F.col("vf") == F.col("cand"))
    able = requests.join(v, "voter").filter((F.col("term") >= F.col("vt")) & free & up_to_date(F.col("lt"), F.col("li"), F.col("vlt"), F.col("vli")))
    newest = able.groupBy("voter").agg(F.max("term").alias("term"))
    return able.join(newest, ["voter", "term"]).groupBy("voter").agg(F.min_by("cand", "arrival").alias("cand"))


def roles(events: DataFrame) -> DataFrame:
    """(node, at, kind, term, role) after every event of ``events(node, at, kind, seen)``, ``at`` unique in a node.

    Kinds: ``timeout`` makes a candidate of the next term; ``won`` makes a candidate the leader; ``saw`` a message of term
    ``seen`` makes a follower of a newer term.  Nodes begin as followers of term 0.  A node's term is the number of its
    timeouts plus the most that a term it saw was ahead of those before it, so windows tell it without a fold.
    """
    order = Window.partitionBy("node").orderBy("at")
    timeouts = F.count_if(F.col("kind") == "timeout").over(order)
    ahead = F.max(F.when(F.col("kind") == "saw", F.col("seen") - F.col("timeouts")).otherwise(0)).over(order)
    df = events.withColumn("timeouts", timeouts).withColumn("term", (F.col("timeouts") + F.greatest(ahead, F.lit(0))).cast("bigint"))
    risen = (F.col("kind") == "saw") & (F.col("term") > F.coalesce(F.lag("term").over(order), F.lit(0)))
    df = df.withColumn("turn", F.when(F.col("kind") == "timeout", "candidate").when(risen, "follower"))
    held = F.coalesce(F.last("turn", ignorenulls=True).over(order), F.lit("follower"))
    df = df.withColumn("turn", F.when((F.col("kind") == "won") & (held == "candidate"), "leader").otherwise(F.col("turn")))
    role = F.coalesce(F.last("turn", ignorenulls=True).over(order), F.lit("follower"))
    return df.select("node", "at", "kind", "term", role.alias("role"))


def applied(log: DataFrame, commit: int) -> DataFrame:
    """Live state once all entries up to ``commit`` have been applied in order."""
    return latest(log.filter(F.col("idx") <= commit).select("k", F.col("idx").alias("seq"), "op", "v")).select("k", "v", F.col("seq").alias("idx"))


def append_requests(peers: DataFrame, log: DataFrame) -> DataFrame:
    """Per peer of ``peers(peer, m)``: the index before the entries to send, how many there are, and the last.

    The log is contiguous, so its end says what each peer lacks; peers don't join all entries.
    """
    end = log.agg(F.max("idx").alias("last"))
    n = F.greatest(F.col("last") - F.col("m"), F.lit(0))
    return peers.crossJoin(F.broadcast(end)).select("peer", F.col("m").alias("prev_idx"), n.cast("bigint").alias("n_entries"), F.when(n > 0, F.col("last")).alias("last_idx"))


def progress(acks: DataFrame) -> DataFrame:
    """Per peer of ``acks(peer, sent, ok)``: the match index and the next; a success sets both, a failure steps the
    next index back by one, not below 1, until the next success."""
    last_ok = acks.groupBy("peer").agg(F.coalesce(F.max(F.when(F.col("ok") == 1, F.col("sent"))), F.lit(0).cast("bigint")).alias("match_index"), F.max(F.when(F.col("ok") == 1, F.col("at"))).alias("ok_at"))
    failed = acks.join(last_ok, "peer").filter((F.col("ok") == 0) & (F.col("at") > F.coalesce("ok_at", F.lit(-1)))).groupBy("peer").agg(F.count("*").alias("failed"))
    joined = last_ok.join(failed, "peer", "left")
    return joined.select("peer", "match_index", F.greatest(F.lit(1).cast("bigint"), F.col("match_index") + 1 - F.coalesce("failed", F.lit(0))).alias("next_index"))


def answered(pending: DataFrame, log: DataFrame, commit: int) -> DataFrame:
    """(idx, applied) of every pending proposal."""
    done = log.filter(F.col("idx") <= commit).select("idx", F.lit(True).alias("done"))
    return pending.select("idx").join(done, "idx", "left").select("idx", F.coalesce("done", F.lit(False)).alias("applied"))


def appended(log: DataFrame, proposals: DataFrame, term: int) -> DataFrame:
    """R2: entries for ``proposals(n, op, k, v)``, n from 1 in order of arrival: index after the last, the leader's term."""
    last = log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("last"))
    return proposals.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("n")).alias("idx"), F.lit(term).cast("bigint").alias("term"), "op", "k", "v")


def micro_batches(proposals: DataFrame, size: int = 1000) -> DataFrame:
    """(batch, first, last, n): proposals flushed ``size`` at a time."""
    return proposals.groupBy(F.floor((F.col("n") - 1) / size).cast("bigint").alias("batch")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("n"))

"""A persistent versioned store: ``put``, ``delete``, atomic batches, snapshots, scans, flush and compaction on Parquet.

Folder: ``log/<number>`` (committed batches), ``run/<level>-<number>`` (sorted runs) and ``manifest/<edit>.json``.  An edit is
written beside its place and renamed, so a reader sees all of it or nothing; files that no manifest names don't count.
One writer at a time, any number of readers.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import CHANGE_LOG, COMPACTION_TRIGGER, DELETE, PUT, InvalidArgument, NotFound
from palimpsest.operators import lookup, resolve, runs
from palimpsest.operators.ordered import row_numbers


# What a client is told.
NOT_LEADER, FAILED, TIMED_OUT = "Not the leader", "Propose failed", "Timeout waiting for consensus"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._state = {"edit": 0, "last_seq": 0, "next_file": 2, "logs": [], "runs": [], "snapshots": []}
        self._recover()

    # -- manifest ---------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _recover(self) -> None:
        """The newest manifest; without one the store is empty."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if names:
            text = self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0]
            self._state = {"snapshots": []} | json.loads(text)

    def _commit(self, **change) -> None:
        """The state after the edit, in place by one rename."""
        state = self._state | change | {"edit": self._state["edit"] + 1}
        name = f"{self.path}/manifest/{state['edit']:012d}.json"
        fs, tmp = self._fs(name + ".tmp")
        out = fs.create(tmp, True)
        out.write(json.dumps(state).encode())
        out.close()
        # Some file systems rename over a file that is there.
        if fs.exists(self._fs(name)[1]) or not fs.rename(tmp, self._fs(name)[1]):
            fs.delete(tmp, False)
            raise InvalidArgument(f"another writer made edit {state['edit']}")
        self._state = state

    def _number(self) -> int:
        n = self._state["next_file"]
        self._state["next_file"] = n + 1
        return n

    # -- writing ----------------------------------------------------------

    @property
    def last_seq(self) -> int:
        return self._state["last_seq"]

    def put(self, key: str, value: str) -> int:
        return self.write([(PUT, key, value)])

    def delete(self, key: str) -> int:
        """Blind: the key need not exist."""
        return self.write([(DELETE, key, "")])

    def write(self, operations: list[tuple], sync: bool = True, disable_wal: bool = False) -> int:
        """An atomic batch of (op, key, value), in order; the sequence of its last operation.  Nothing of a bad batch is applied.

        ``sync`` and ``disable_wal`` are accepted and change nothing: a batch is its log file, and durable once it returns.
        """
        for op, key, value in operations:
            if op not in (DELETE, PUT) or key is None or (op == PUT and value is None):
                raise InvalidArgument(f"operation {(op, key)!r}")
        rows = [(k, self.last_seq + i, op, v if op == PUT else "") for i, (op, k, v) in enumerate(operations, 1)]
        return self._append(self.spark.createDataFrame(rows, CHANGE_LOG), len(rows)) if rows else self.last_seq

    def write_frame(self, operations: DataFrame, order: str = "pos") -> int:
        """An atomic batch of any size: ``operations(pos, op, k, v)`` takes sequences in the order of the integer ``pos``."""
        bad = operations.filter(F.col("op").isNull() | ~F.col("op").isin(DELETE, PUT) | F.col("k").isNull() | ((F.col("op") == PUT) & F.col("v").isNull()))
        if not bad.isEmpty():
            raise InvalidArgument("an operation has an unknown kind, no key or no value")
        numbered = row_numbers(operations, F.floor(F.col(order) / 1_000_000), [F.col(order)], "n")
        rows = numbered.select("k", (F.col("n") + self.last_seq).alias("seq"), F.col("op").cast("int").alias("op"), F.when(F.col("op") == PUT, F.col("v")).otherwise("").alias("v"))
        return self._append(rows, None)

    def _append(self, rows: DataFrame, n: int | None) -> int:
        number = self._number()
        fs, path = self._fs(f"{self.path}/log/{number}")
        if fs.exists(path):
            raise InvalidArgument(f"another writer made log {number}")
        rows.write.parquet(f"{self.path}/log/{number}")
        n = self._read(f"log/{number}").count() if n is None else n
        self._commit(last_seq=self.last_seq + n, logs=[*self._state["logs"], number])
        return self.last_seq

    # -- reading ----------------------------------------------------------

    def _read(self, *names: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], CHANGE_LOG)
        return self.spark.read.schema(CHANGE_LOG).parquet(*[f"{self.path}/{n}" for n in names])

    def _run(self, r: dict) -> str:
        return f"run/{r['level']}-{r['number']}"

    def versions(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """Every version kept.  Runs whose recorded bounds lie outside low <= k < high aren't read."""
        within = [r for r in self._state["runs"] if not (low is not None and r["largest"] < low) and not (high is not None and r["smallest"] >= high)]
        return self._read(*[f"log/{n}" for n in self._state["logs"]], *map(self._run, within))

    def get(self, key: str, snapshot: int | None = None) -> str | None:
        """The value of a key, None if it isn't there or deleted."""
        row = lookup.point_get(self.versions(key, key + "\0"), key, snapshot).first()
        return row.v if row.found else None

    def __getitem__(self, key: str) -> str:
        if (value := self.get(key)) is None:
            raise NotFound(key)
        return value

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return lookup.multi_get(self.versions(), keys, snapshot)

    def scan(self, low: str | None = None, high: str | None = None, snapshot: int | None = None) -> DataFrame:
        return lookup.range_scan(self.versions(low, high), low, high, snapshot)

    def state(self, snapshot: int | None = None) -> DataFrame:
        return resolve.latest(self.versions(), snapshot)

    @property
    def snapshots(self) -> list[int]:
        return self._state["snapshots"]

    def refresh(self) -> None:
        """The newest state, as other users of the folder have left it."""
        self._recover()

    def snapshot(self) -> int:
        """A sequence that flushes and compactions keep readable, whoever makes them, until it is released."""
        self.refresh()
        self._commit(snapshots=[*self.snapshots, self.last_seq])
        return self.last_seq

    def release(self, snapshot: int) -> None:
        self.refresh()
        kept = list(self.snapshots)
        kept.remove(snapshot)
        self._commit(snapshots=kept)

    # -- background work --------------------------------------------------

    def _retained(self, versions: DataFrame, tombstones: bool) -> DataFrame:
        """The versions that the newest state or a snapshot needs: those after the oldest snapshot, and the newest at or before it."""
        oldest = min([self.last_seq, *self.snapshots])
        base = resolve.newest(versions.filter(F.col("seq") <= oldest))
        base = base if tombstones else resolve.live(base)
        return base.unionByName(versions.filter(F.col("seq") > oldest))

    def _write_run(self, versions: DataFrame, level: int) -> dict:
        number = self._number()
        path = f"{self.path}/run/{level}-{number}"
        ordered = versions.select("k", "seq", "op", "v").repartitionByRange("k").sortWithinPartitions("k", F.desc("seq"))
        ordered.write.option("parquet.bloom.filter.enabled#k", "true" if level else "false").parquet(path)
        low, high, n = self._read(f"run/{level}-{number}").agg(F.min("k"), F.max("k"), F.count("*")).first()
        return {"level": level, "number": number, "smallest": low or "", "largest": high or "", "entries": n}

    def flush(self) -> None:
        """Logs become one run of level 0; deletions stay, as they hide older runs."""
        self.refresh()
        if logs := self._state["logs"]:
            run = self._write_run(self._retained(self._read(*[f"log/{n}" for n in logs]), True), 0)
            self._commit(logs=[], runs=[*self._state["runs"], run])

    def compact(self, force: bool = False) -> bool:
        """All runs become one of level 1, without deletions; only from COMPACTION_TRIGGER runs of level 0 on."""
        self.refresh()
        files = self._state["runs"]
        if not files or not force and sum(r["level"] == 0 for r in files) < COMPACTION_TRIGGER:
            return False
        run = self._write_run(self._retained(self._read(*map(self._run, files)), False), 1)
        self._commit(runs=[run])
        return True

    def vacuum(self) -> None:
        """Delete logs and runs that the manifest no longer names."""
        kept = {f"log/{n}" for n in self._state["logs"]} | set(map(self._run, self._state["runs"]))
        for part in ("log", "run"):
            fs, folder = self._fs(f"{self.path}/{part}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{part}/{s.getPath().getName()}" not in kept:
                    fs.delete(s.getPath(), True)


class Service:
    """The three calls of a client, as dictionaries: ``success`` or ``found``, and ``error``, never an exception.

    Only a leader writes; ``timeout`` seconds (None: any) are what a write may take before the caller is told so.  It may
    still come to pass afterwards, as with any replicated store.
    """

    def __init__(self, store: Store, is_leader=lambda: True, timeout: float | None = None):
        self.store, self.is_leader, self.timeout = store, is_leader, timeout
        self._calls = ThreadPoolExecutor(1)  # writes one after another

    def _try(self, call) -> dict:
        if not self.is_leader():
            return {"success": False, "error": NOT_LEADER}
        try:
            self._calls.submit(call).result(self.timeout)
            return {"success": True, "error": ""}
        except TimeoutError:
            return {"success": False, "error": TIMED_OUT}
        except Exception as e:  # noqa: BLE001  the caller gets the reason instead
            return {"success": False, "error": f"{FAILED}: {str(e) or type(e).__name__}"}

    def put(self, key: str, value: str) -> dict:
        return self._try(lambda: self.store.put(key, value))

    def delete(self, key: str) -> dict:
        return self._try(lambda: self.store.delete(key))

    def get(self, key: str) -> dict:
        value = self.store.get(key)
        return {"found": value is not None, "value": value or "", "error": "" if value is not None else "Key not found"}


def stats(store: Store) -> DataFrame:
    return runs.run_stats(runs.generations(store.versions(), 1000))

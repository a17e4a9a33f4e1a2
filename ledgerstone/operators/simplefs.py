"""The file table of a volume: create, format, allocate, free, delete, replayed from an operation log.

Allocation depends on all operations before it, so a volume is one fold in order of `seq`; volumes
are independent groups.  State is the free list, whose front is taken and to whose end freed blocks
go, and the blocks of each file.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "volume long, seq long, status string, blocks array<bigint>, free long"
STATE = "volume long, state string"


class Table:
    """One volume's blocks and files."""

    def __init__(self, block_size: int) -> None:
        self.block_size, self.total = block_size, 0
        self.free: deque[int] = deque()
        self.files: dict[str, tuple[int, list[int]]] = {}

    def create_volume(self, size: int) -> tuple[str, list[int]]:
        if size % self.block_size:
            return "bad_size", []
        self.total = size // self.block_size
        return self.format()

    def format(self) -> tuple[str, list[int]]:
        self.free, self.files = deque(range(self.total)), {}
        return "ok", []

    def create(self, path: str, size: int) -> tuple[str, list[int]]:
        """A file of this name goes first, also if there is no room for the new one."""
        if path in self.files:
            self.free.extend(self.files.pop(path)[1])
        n = -(-size // self.block_size)
        if n > len(self.free):
            return "no_space", []
        blocks = [self.free.popleft() for _ in range(n)]
        self.files[path] = (size, blocks)
        return "ok", blocks

    def delete(self, path: str) -> tuple[str, list[int]]:
        if path not in self.files:
            return "not_found", []
        blocks = self.files.pop(path)[1]
        self.free.extend(blocks)
        return "ok", blocks

    def apply(self, op: str, path: str | None, size: int | None) -> tuple[str, list[int]]:
        if op == "create_volume":
            return self.create_volume(size or 0)
        if op == "format":
            return self.format()
        if op == "create":
            return self.create(path or "", size or 0)
        return self.delete(path or "") if op == "delete" else ("unknown", [])

    def dump(self) -> str:
        files = {p: {"Filename": p, "Size": s, "Blocks": b} for p, (s, b) in sorted(self.files.items())}
        return json.dumps({"Blocksize": self.block_size, "Volume": {"Size": self.total, "Free": list(self.free)}, "Blocks": files}, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Table:
        d = json.loads(text)
        t = cls(d["Blocksize"])
        t.total, t.free = d["Volume"]["Size"], deque(d["Volume"]["Free"])
        t.files = {p: (f["Size"], f["Blocks"]) for p, f in d["Blocks"].items()}
        return t


def _in_order(table: pa.Table) -> list[dict]:
    return table.sort_by("seq").select(["volume", "seq", "op", "path", "size"]).to_pylist()


def replay(ops: DataFrame, block_size: int) -> DataFrame:
    """Result of each operation (volume, seq, op, path, size): status, the blocks taken or freed, how many are free then."""

    def fold(table: pa.Table) -> pa.Table:
        t, out = Table(block_size), []
        for r in _in_order(table):
            status, blocks = t.apply(r["op"], r["path"], r["size"])
            out.append({"volume": r["volume"], "seq": r["seq"], "status": status, "blocks": blocks, "free": len(t.free)})
        return pa.Table.from_pylist(out, pa.schema([("volume", pa.int64()), ("seq", pa.int64()), ("status", pa.string()), ("blocks", pa.list_(pa.int64())), ("free", pa.int64())]))

    return ops.groupBy("volume").applyInArrow(fold, RESULT)


def save(ops: DataFrame, block_size: int) -> DataFrame:
    """(volume, state): the state of each volume after its log, as a document."""

    def fold(table: pa.Table) -> pa.Table:
        t, rows = Table(block_size), _in_order(table)
        for r in rows:
            t.apply(r["op"], r["path"], r["size"])
        return pa.table([pa.array([rows[0]["volume"]], pa.int64()), pa.array([t.dump()])], ["volume", "state"])

    return ops.groupBy("volume").applyInArrow(fold, STATE)


def resume(states: DataFrame, ops: DataFrame, block_size: int) -> DataFrame:
    """(volume, state) after more operations on saved states; a volume without a state starts empty."""

    def fold(state: pa.Table, table: pa.Table) -> pa.Table:
        t = Table.load(state["state"][0].as_py()) if len(state) else Table(block_size)
        for r in _in_order(table):
            t.apply(r["op"], r["path"], r["size"])
        volume = (state if len(state) else table)["volume"][0].as_py()
        return pa.table([pa.array([volume], pa.int64()), pa.array([t.dump()])], ["volume", "state"])

    return states.groupBy("volume").cogroup(ops.groupBy("volume")).applyInArrow(fold, STATE)


def files(states: DataFrame) -> DataFrame:
    """(volume, path, size, blocks) of saved states."""
    s = F.from_json("state", "Blocks map<string, struct<Size: bigint, Blocks: array<bigint>>>")
    return states.select("volume", F.explode(s["Blocks"]).alias("path", "f")).select("volume", "path", F.col("f.Size").alias("size"), F.col("f.Blocks").alias("blocks"))

"""Merkle manifest of a dataset: ordered appends attach witnesses to open subtrees, and every later sibling extends them.

Leaves are appended in order, in aligned blocks of ``arity ** height``. While a block is open, each leaf has a partial witness: the siblings that are
complete so far, level by level. When a run of siblings completes, the witness of every leaf below it is extended. The root of a block
is one append to the next tree, so a group of any size is many blocks, and the witnesses of a block's leaves are extended by the block's own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsift.llm.common import col, cut_lineage, ship
from tabsift.llm.ranked import ranked

ARITY, HEIGHT = 3, 7
#: Groups as text: '' for null, which comes first, else '+' and the group, whose order is that of its UTF-8 bytes.
GROUP = "grp"


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class Block:
    """An open run of nodes on each level, and a witness for each leaf appended so far.

    A witness is a string of levels from the leaf upward: one byte each for the place in the run and the run's size, then the siblings' digests.
    """

    def __init__(self, arity: int):
        self.arity, self.runs, self.witnesses = arity, [], []

    def append(self, digest: bytes) -> None:
        at = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._push(0, digest, at, at + 1)

    def _push(self, level: int, digest: bytes, start: int, end: int) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((digest, start, end))
        if len(self.runs[level]) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        for k, (_, start, end) in enumerate(run):
            step = bytes((k, len(run))) + b"".join(d for i, (d, _, _) in enumerate(run) if i != k)
            for w in self.witnesses[start:end]:
                w += step
        self._push(level + 1, parent([d for d, _, _ in run]), run[0][1], run[-1][2])

    def close(self, height: int | None) -> bytes:
        """The root: of a tree of this height if more blocks follow or came before, else as soon as one node is left."""
        level = 0
        while (level < height) if height is not None else sum(map(len, self.runs)) > 1:
            if self.runs[level]:
                self._complete(level)
            level += 1
        return next(run for run in self.runs if run)[0][0]


def _appended(batches, arity: int, height: int):
    """A row per node with its partial witness; the last one of a block has the block's root."""
    size, block, now, held = arity ** height, None, None, []

    def closed():
        root = block.close(height if held[0][4] > size else None)
        roots = [None] * (len(held) - 1) + [root]
        return [(*h[:5], bytes(w), r) for h, w, r in zip(held, block.witnesses, roots)]

    names = [GROUP, "block", "rank", "digest", "n", "witness", "root"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    done = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names[:5])):
            if row[:2] != now:
                if held:
                    done += closed()
                    if len(done) >= 4096:
                        yield batch(done)
                        done = []
                block, now, held = Block(arity), row[:2], []
            block.append(row[3])
            held.append(row)
    if held:
        yield batch(done + closed())


def forest(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Trees over (grp, rank, digest, n): the stored rows of each round of blocks, and (grp, root).

    A round leaves one node per block, so ``arity ** height`` times fewer; rounds end when every group has one.
    """
    rounds, roots, schema = [], None, f"{GROUP} string, block long, rank long, digest binary, n long, witness binary, root binary"
    while True:
        rows = nodes.select(GROUP, F.floor(F.col("rank") / arity ** height).alias("block"), "rank", "digest", "n")
        rows = rows.repartition(GROUP, "block").sortWithinPartitions(GROUP, "block", "rank")
        done = cut_lineage(rows.mapInArrow(lambda b: _appended(b, arity, height), schema))
        rounds.append(done)
        left = done.filter("root is not null").select(GROUP, F.col("block").alias("rank"), F.col("root").alias("digest"),
                                                      F.ceil(F.col("n") / arity ** height).alias("n"))
        ended = left.filter("n = 1").select(GROUP, F.col("digest").alias("root"))
        roots = ended if roots is None else roots.union(ended)
        nodes = left.filter("n > 1")
        if not nodes.take(1):
            return rounds, roots


def _extended(rounds: list[DataFrame], tops: DataFrame | None) -> DataFrame:
    """(grp, block, above, root): how the witness of each block of the first round goes on, through all later rounds and then ``tops`` (grp, witness, root)."""
    above = None
    for r in reversed(rounds[1:]):
        own = r.select(GROUP, "block", F.col("rank").alias("below"), "witness")
        if above is None:
            joined = own.withColumn("above", F.lit(b""))
        else:
            joined = own.join(above, [GROUP, "block"], "left").withColumn("above", F.coalesce("above", F.lit(b"")))
        above = joined.select(GROUP, F.col("below").alias("block"), F.concat("witness", "above").alias("above"))
    blocks = rounds[0].filter("root is not null").select(GROUP, "block")
    blocks = blocks.withColumn("above", F.lit(b"")) if above is None else blocks.join(above, [GROUP, "block"], "left").withColumn("above", F.coalesce("above", F.lit(b"")))
    return blocks.join(tops.withColumnRenamed("witness", "top"), GROUP).select(GROUP, "block", F.concat("above", "top").alias("above"), "root")


def field_digest(*fields: str) -> Column:
    """SHA-256 of the fields one after another: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    def one(name):
        value = col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(one(f) for f in fields)), 256))


def manifest(rows: DataFrame, leaf: str, group: str, order: list[str], arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """The rows with ``subroot`` and ``root`` (binary) and ``witness``: the whole path from the leaf through its group's tree to the root.

    ``leaf`` is a column of digests. Leaves of a group are ordered by ``order`` (nulls first) and then by digest, so equal rows are interchangeable; groups by the UTF-8 bytes of the group
    as text, null first. On each level every ``arity`` consecutive nodes become their parent, a last run of fewer too, while more than one node is left. No rows give no rows.
    Nothing but one root of 32 bytes goes to the driver. Input columns with a result's name are replaced.
    """
    ship(rows.sparkSession)
    own = {c: f"in{k}" for k, c in enumerate(rows.columns)}
    named = F.coalesce(F.concat(F.lit("+"), col(group).cast("string")), F.lit(""))
    stored = cut_lineage(rows.select(*(col(c).alias(k) for c, k in own.items()), named.alias(GROUP)))
    leaves = cut_lineage(ranked(stored, GROUP, [own[c] for c in [*order, leaf]]))
    rounds, subroots = forest(leaves.select(GROUP, "rank", F.col(own[leaf]).alias("digest"), "n"), arity, height)
    subroots = cut_lineage(subroots)
    tops = ranked(subroots.withColumn("all", F.lit("")), "all", [GROUP])
    tops = cut_lineage(tops.select(GROUP, "rank", "n", "root"))
    over, root = forest(tops.select(F.lit("").alias(GROUP), "rank", F.col("root").alias("digest"), "n"), arity, height)
    top = root.first()
    path = over[0].select(F.col("rank").alias("at"), "block", "witness").join(
        _extended(over, root.withColumn("witness", F.lit(b""))).select("block", "above"), "block").select("at", F.concat("witness", "above").alias("witness"))
    tops = tops.join(path, tops["rank"] == path["at"]).select(GROUP, "witness", "root")
    above = cut_lineage(_extended(rounds, tops).withColumnRenamed("root", "subroot"))
    partial = rounds[0].select(GROUP, "block", "rank", "witness")
    out = leaves.withColumn("block", F.floor(F.col("rank") / arity ** height))
    out = out.join(partial, [GROUP, "block", "rank"]).join(above, [GROUP, "block"])
    return out.select(*(F.col(k).alias(c) for c, k in own.items() if c not in ("subroot", "root", "witness")), "subroot",
                      F.lit(bytes(top["root"]) if top else b"").alias("root"), F.concat("witness", "above").alias("witness"))


def _steps(witness: bytes):
    at = 0
    while at < len(witness):
        place, size = witness[at], witness[at + 1]
        end = at + 2 + 32 * (size - 1)
        yield place, [witness[k:k + 32] for k in range(at + 2, end, 32)]
        at = end


def folded(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and a witness give."""
    for place, siblings in _steps(witness):
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


def proof_digest(witness: bytes) -> str:
    """Of all siblings, as hex text, from the leaf upward and from left to right."""
    return hashlib.sha256("".join(d.hex() for _, siblings in _steps(witness) for d in siblings).encode()).hexdigest()


def checked(rows: DataFrame, leaf: str) -> DataFrame:
    """The rows of a manifest with ``proof_sha256`` and ``folded_root``, the root that the digests in ``leaf`` give with the stored witnesses."""
    ship(rows.sparkSession)
    own = {c: f"in{k}" for k, c in enumerate(rows.columns) if c not in ("proof_sha256", "folded_root")}
    out = rows.select(*(col(c).alias(k) for c, k in own.items()), F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"))

    def fold(batches):
        for b in batches:
            paths = b.column(own["witness"]).to_pylist()
            proofs = [proof_digest(w) for w in paths]
            roots = [folded(d, w).hex() for d, w in zip(b.column(own[leaf]).to_pylist(), paths)]
            arrays = [pa.array(proofs, pa.string()) if n == "proof_sha256" else pa.array(roots, pa.string()) if n == "folded_root" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return out.mapInArrow(fold, out.schema).select(*(F.col(k).alias(c) for c, k in own.items()), "proof_sha256", "folded_root")

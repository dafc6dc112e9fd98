"""Conversation structure repair: faults of each conversation, and the cheapest audit of edits that makes its roles alternate.

Conversations of a bounded number of rows and bytes are sorted side by side in a task and repaired one after another. Longer ones are ranked without gathering
them, cut into blocks, and each block's costs and audits are computed for every state that it may be entered in; only a few numbers per block pass in
order. Their rows are read in order once, as a hash of the whole repaired text has to.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsift.llm.audit import ENDS, FAR, INSERT_COST, STATES, Row, applied, best, costs
from tabsift.llm.common import col, cut_lineage, ship
from tabsift.llm.ranked import ranked

WHITE = " \t\n\x0b\x0c\r"
ALLOWED = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK_ROWS, WHOLE_BYTES = 4096, 64 << 20


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after the damage that their CRC-32 of ``id:turn`` draws, with ``present``: false for a row that only names its conversation, as it was dropped.

    Of 20 draws, 0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 sets the role user. Null
    ids and turns count as one space in the draw and stay null; null roles and texts become one space.
    """
    def spaced(c):
        return F.coalesce(c.cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced(col(id_col)), F.lit(":"), spaced(col(turn_col))).cast("binary")) % 20
    text, role = spaced(col(text_col)), spaced(col(role_col))
    rows = conversations.select(col(id_col).alias(id_col), col(turn_col).alias(turn_col), F.when(draw == 4, "user").otherwise(role).alias(role_col),
                                F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
                                (draw != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(draw == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _faulty(text: Column) -> tuple[Column, Column]:
    bare = F.rtrim(text, F.lit(WHITE))
    return bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")


def _pairs(initials: list[str]) -> int:
    return sum(a + b not in ALLOWED for a, b in zip(initials, initials[1:]))


def _whole(key, rows) -> tuple:
    """The result of one conversation whose rows are all here, in order."""
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, items, counts = set(), [], [0, 0, 0]
    for _, _, role, text, digest, blank, truncated in rows:
        again = (role, digest) in seen
        seen.add((role, digest))
        if blank or again or truncated:
            counts[0 if blank else 1 if again else 2] += 1
        items.append(Row(role[:1], blank or again, truncated))
    cost, _, audit = best(items)
    lines, _ = applied(audit, [r[2] for r in rows])
    repaired = "\n".join(f"{role}:{'' if at is None else rows[at][3]}" for at, role in lines if role is not None)
    return (key, gaps, *counts, _pairs([r[2][:1] for r in rows]), cost, audit, hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest())


def _groups(batches, names, by):
    """Runs of rows of equal leading columns, across batches; only one run is held."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in names)):
            if row[:by] != now:
                if held:
                    yield now, held
                now, held = row[:by], []
            held.append(row)
    if held:
        yield now, held


def _emitted(rows, names, kinds, size=2048):
    done = []
    for row in rows:
        done.append(row)
        if len(done) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)


def _arrow(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` yields tuples from (names, batches); they become rows of the schema."""
    names = rows.columns
    out, plain = [c.split()[0] for c in schema.split(", ")], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
                                                             "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    types = [plain[c.split()[1]] for c in schema.split(", ")]
    return rows.mapInArrow(lambda batches: _emitted(function(names, batches), out, types), schema)


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations that one task can hold one at a time."""
    def each(names, batches):
        for (key,), held in _groups(batches, names, 1):
            yield _whole(key, held)
    own = rows.select("key", "turn", "role", "text", "digest", "blank", "truncated")
    return _arrow(own.repartition("key").sortWithinPartitions("key", "turn", "role", "digest"), each, RESULT)


def _long(rows: DataFrame, block_rows: int) -> DataFrame:
    """Results of conversations of any length, block by block."""
    rows = cut_lineage(ranked(cut_lineage(rows), "key", ["turn", "role", "digest"]).withColumn("block", F.floor(F.col("rank") / block_rows)))
    # a role and text that a conversation repeats is a duplicate from its second place on; copies of one text are dealt by a salt
    first = rows.groupBy("key", "role", "digest").agg(F.min("rank").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    slim = rows.select("key", "block", "rank", "turn", "role", "digest", "blank", "truncated", (F.col("rank") % 16).alias("salt"))
    slim = slim.join(first, ["key", "role", "digest", "salt"], "left").withColumn("duplicate", F.coalesce(F.col("rank") > F.col("first"), F.lit(False)))
    slim = cut_lineage(slim.select("key", "block", "rank", "role", "turn", (F.col("blank") | F.col("duplicate")).alias("forced"), "truncated", "blank"))

    turns = slim.groupBy("key", "turn").agg(F.count_if("blank").alias("blank"), F.count_if(F.col("forced") & ~F.col("blank")).alias("duplicate"),
                                            F.count_if(F.col("truncated") & ~F.col("forced")).alias("truncated"))
    faults = turns.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
                                      *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    blocks = slim.select("key", "block", "rank", "role", "forced", "truncated")
    dealt = blocks.repartition("key", "block").sortWithinPartitions("key", "block", "rank")

    def items(held):
        return [Row(r[3][:1], r[4], r[5]) for r in held]

    def priced(names, batches):
        for (key, block), held in _groups(batches, names, 2):
            initials = [r[3][:1] for r in held]
            yield key, block, [c for row in costs(items(held)) for c in row], _pairs(initials), initials[0], initials[-1]

    matrices = _arrow(dealt, priced, "key string, block long, matrix array<long>, illegal long, head string, tail string")

    def backward(names, batches):
        """From the last block to the first: what follows costs, from each state after the block; a conversation's rows are a few numbers each."""
        now, ahead, head, illegal = None, None, None, 0
        for b in batches:
            for key, block, matrix, within, first_one, last_one in zip(*(b.column(c).to_pylist() for c in names)):
                if key != now:
                    now, head, illegal = key, None, 0
                    ahead = [0 if s in ENDS else INSERT_COST * (2 if s == 1 else 1) for s in STATES]
                illegal += within + (head is not None and last_one + head not in ALLOWED)
                yield key, block, ahead, head is None, illegal
                ahead = [min(FAR, min(matrix[4 * e + s] + ahead[s] for s in STATES)) for e in STATES]
                head = first_one

    ahead = cut_lineage(_arrow(matrices.repartition("key").sortWithinPartitions("key", F.col("block").desc()), backward,
                               "key string, block long, ahead array<long>, final boolean, illegal long"))

    def audits(names, batches):
        for (key, block), held in _groups(batches, names, 2):
            after, final = held[0][6], held[0][7]
            for entry in STATES if block else STATES[:1]:
                cost, state, audit = best(items(held), entry, None if final else after)
                yield key, block, entry, state, cost, audit

    told = blocks.join(ahead.select("key", "block", "ahead", "final"), ["key", "block"]).select(*blocks.columns, "ahead", "final")
    choices = _arrow(told.repartition("key", "block").sortWithinPartitions("key", "block", "rank"), audits,
                     "key string, block long, entry long, state long, cost long, audit string")

    def forward(names, batches):
        """From the first block on: of each block the audit for the state that the ones before it leave."""
        now, state, at = None, 0, None
        for b in batches:
            for key, block, entry, leaves, cost, audit in zip(*(b.column(c).to_pylist() for c in names)):
                if key != now:
                    now, state, at = key, 0, None
                if block != at and entry == state:
                    at, state = block, leaves
                    yield key, block, entry, cost if block == 0 else None, audit

    chosen = cut_lineage(_arrow(choices.repartition("key").sortWithinPartitions("key", "block", "entry"), forward,
                                "key string, block long, entry long, cost long, audit string"))
    audit = chosen.groupBy("key").agg(F.max("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts"))
    audit = audit.select("key", "cost", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))

    def edits(names, batches):
        """Per row: the role that it keeps or gets, null if it goes, and the roles inserted before it and, after the last one, behind it."""
        for _, held in _groups(batches, names, 2):
            lines, _ = applied(held[0][5], [r[3] for r in held], held[0][4])
            waiting, at, out = [], None, []
            for k, role in lines:
                if k is None:
                    waiting.append(role)
                else:
                    at = held[k]
                    out.append([at[0], at[2], role, ",".join(waiting), ""])
                    waiting = []
            if out and waiting:
                out[-1][4] = ",".join(waiting)
            yield from map(tuple, out)

    applied_to = blocks.join(chosen, ["key", "block"]).select("key", "block", "rank", "role", "entry", "audit")
    done = _arrow(applied_to.repartition("key", "block").sortWithinPartitions("key", "block", "rank"), edits,
                  "key string, rank long, written string, before string, behind string")

    def hashed(names, batches):
        """One row after another; nothing of a conversation is held but the hash's state."""
        now, digest, begun = None, None, False
        for b in batches:
            for key, _, text, role, before, behind in zip(*(b.column(c).to_pylist() for c in names)):
                if key != now:
                    if now is not None:
                        yield now, digest.hexdigest()
                    now, digest, begun = key, hashlib.sha256(), False
                lines = [f"{r}:" for r in before.split(",") if r] + ([f"{role}:{text}"] if role is not None else []) + [f"{r}:" for r in behind.split(",") if r]
                for line in lines:
                    digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
        if now is not None:
            yield now, digest.hexdigest()

    texts = rows.select("key", "rank", "text").join(done, ["key", "rank"]).select("key", "rank", "text", "written", "before", "behind")
    hashes = _arrow(texts.repartition("key").sortWithinPartitions("key", "rank"), hashed, "key string, repaired_sha256 string")
    illegal = ahead.filter("block = 0").select("key", "illegal")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return faults.join(illegal, "key").join(audit, "key").join(hashes, "key").select(*names)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None,
           block_rows: int = BLOCK_ROWS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Rows of a conversation are taken by turn (an integer; nulls first), then role and MD5 of the text. Faults, the first of which counts for a row: blank
    (white space only), duplicate (role and text seen earlier), truncated (doesn't end in a full stop, exclamation or question mark). ``gaps`` are turns missing between the first and last,
    ``illegal`` neighbouring rows whose roles' initials are not su, ua or au. ``audit`` has an initial per edit: Keep (0), Rerole to user or assistant (3),
    Delete (4; has to be for blank and duplicate rows), Insert an empty user or assistant row (3); a truncated row that stays costs 3 more. It is the cheapest one that leaves
    roles ``(s?(ua)+)?``, ties go to the least in ASCII. The hash is of the repaired ``role:text`` lines.

    Null roles and texts count as one space; a null id is a conversation of its own. Where ``present_col`` is false, a row only names its conversation. Without rows a conversation
    has zeros, an empty audit and the hash of nothing. Other columns are ignored. No rows give no rows.

    Conversations above ``block_rows`` rows or ``whole_bytes`` characters go block by block, with the same results; an audit is one cell, so it is limited to the length of a string.
    """
    ship(rows.sparkSession)
    present = col(present_col) if present_col else F.lit(True)
    text = F.coalesce(col(text_col), F.lit(" "))
    blank, truncated = _faulty(text)
    rows = rows.select(col(id_col).alias("id"), F.coalesce(F.concat(F.lit("+"), col(id_col).cast("string")), F.lit("-")).alias("key"), col(turn_col).cast("long").alias("turn"),
                       F.coalesce(col(role_col), F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), blank.alias("blank"),
                       truncated.alias("truncated"), present.alias("present"))
    sizes = cut_lineage(rows.groupBy("id", "key").agg(F.count_if("present").alias("rows"), F.sum(F.when(F.col("present"), F.length("text"))).alias("chars")))
    large = sizes.filter((F.col("rows") > block_rows) | (F.col("chars") > whole_bytes)).select("key")
    there = rows.filter("present").drop("present", "id")
    if large.take(1):
        there = there.join(large.withColumn("large", F.lit(True)), "key", "left")
        results = _short(there.filter("large is null").drop("large")).union(_long(there.filter("large").drop("large"), block_rows))
    else:
        results = _short(there)
    out = sizes.select("id", "key").join(results, "key", "left")
    return out.select(F.col("id").alias(id_col), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

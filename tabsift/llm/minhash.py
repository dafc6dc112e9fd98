"""Near-duplicate groups by b-bit MinHash: bands of minima give candidates, packed low bits an estimate, full shingle sets the decision."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabsift.llm.common import cut_lineage, pick, ship
from tabsift.llm.components import connected
from tabsift.llm.wordhash import chunks, distinct, shingles, word_hashes

SHINGLE, PERCENT = 5, 85
#: 192 minima; the first 160 are 32 bands of 5: a pair at 0.85 shares no band with a probability of 7e-9.
MINIMA, BANDS, ROWS, BITS = 192, 32, 5, 4
WORDS = MINIMA // 64
#: Candidates whose estimate lies so many standard deviations below the threshold aren't confirmed on full sets (0.12 at 0.85, 0.135 at 0.80).
DEVIATIONS = 4.485
#: Members of a candidate group that are compared with each other at once.
BLOCK = 256

_factors = np.random.default_rng(20240229).integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """(first row, hashes of the rows' distinct shingles end to end, set sizes), run by run."""
    for row, data, offsets in chunks(texts):
        words, counts = word_hashes(data, offsets)
        yield row, *distinct(*shingles(words, counts, size))


def minima_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over each non-empty set: sets x MINIMA."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), MINIMA), dtype=np.uint64)
    for k, factor in enumerate(_factors if len(starts) else ()):
        out[:, k] = np.minimum.reduceat(hashes * factor, starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each set."""
    keys = np.zeros((len(minima), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        keys = (keys ^ minima[:, j:BANDS * ROWS:ROWS]) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(29)
    return keys


def pack(minima: np.ndarray) -> np.ndarray:
    """The BITS low bits of the minima as bit planes: sets x (BITS * WORDS) integers of 64 bits."""
    planes = [np.packbits(((minima >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1).view(np.uint64) for b in range(BITS)]
    return np.concatenate(planes, axis=1) if len(minima) else np.empty((0, BITS * WORDS), dtype=np.uint64)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _signatures(batches, size: int):
    for batch in batches:
        for row, hashes, sizes in shingle_sets(batch.column("text"), size):
            full = sizes > 0
            minima = minima_of(hashes, sizes)
            raw, ends = hashes.tobytes(), np.cumsum(sizes) * 8
            digests = [hashlib.blake2b(raw[e - 8 * n:e], digest_size=16).digest() if n else None for n, e in zip(sizes, ends)]
            place = pa.array(np.where(full, np.cumsum(full) - 1, -1), mask=~full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(row, len(sizes)), pa.array(sizes), pa.array(digests, pa.binary()),
                 _lists(band_keys(minima)).take(place), _lists(pack(minima)).take(place)], ["id", "n", "digest", "bands", "planes"])


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, n, digest, bands, planes) of (id, text) rows: set size, set digest, band keys, packed low bits; the last three null for empty sets."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(lambda b: _signatures(b, size), f"id {kind}, n long, digest binary, bands array<long>, planes array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: equal low bits, counted in whole words, corrected for chance collisions."""
    differ = [reduce(lambda x, y: x.bitwiseOR(y), (F.col(a)[p * WORDS + w].bitwiseXOR(F.col(b)[p * WORDS + w]) for p in range(BITS)))
              for w in range(WORDS)]
    equal = F.lit(1.0) - reduce(lambda x, y: x + y, map(F.bit_count, differ)) / F.lit(float(MINIMA))
    return (equal - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)


def _similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    out = []
    for _, hashes, sizes in shingle_sets(texts, size):
        out += np.split(hashes, np.cumsum(sizes)[:-1])
    return out


def least_estimate(percent: int) -> float:
    """The estimate from which on a candidate is confirmed; estimates of less similar pairs vary more."""
    chance = 2.0 ** -BITS
    equal = percent / 100 * (1 - chance) + chance
    return percent / 100 - DEVIATIONS * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _confirm(batches, size: int, percent: int):
    """Of rows with two ids, texts and expected digests, those whose full sets are similar enough."""
    for batch in batches:
        left, right = _sets(batch.column("a_text"), size), _sets(batch.column("b_text"), size)
        da, db = batch.column("a_digest").to_pylist(), batch.column("b_digest").to_pylist()
        keep = [_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent) and _digest(x) == p and _digest(y) == q
                for x, y, p, q in zip(left, right, da, db)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _likely(table: pa.Table, percent: int) -> tuple[list[tuple[float, int, int]], list, list]:
    """Pairs of rows across components, between the two blocks of one candidate group, that neither set sizes nor the bit estimate exclude.

    A pair that shares several bands is looked at in the first only. Also the nodes and components by row.
    """
    nodes, blocks = table.column("node").to_pylist(), table.column("block").to_numpy()
    comps, i, j = table.column("component").to_pylist(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    keys = table.column("bands").combine_chunks().values.to_numpy().reshape(len(nodes), BANDS)
    planes = table.column("planes").combine_chunks().values.to_numpy().view(np.uint64).reshape(len(nodes), BITS, WORDS)
    sizes = table.column("n").to_numpy()
    band = int(np.argmax(keys[0] == table.column("key")[0].as_py()))
    names = {c: k for k, c in enumerate(dict.fromkeys(map(repr, comps)))}
    own = np.array([names[repr(c)] for c in comps])
    left = np.flatnonzero(blocks == i)
    right = left if i == j else np.flatnonzero(blocks == j)
    found = []
    for x in left:
        near = right[right > x] if i == j else right
        near = near[own[near] != own[x]]
        near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
        if len(near):
            differ = np.bitwise_or.reduce(planes[near] ^ planes[x], axis=1)
            equal = 1 - np.bitwise_count(differ).sum(axis=1) / MINIMA
            guess = (equal - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)
            near, guess = near[guess >= least_estimate(percent)], guess[guess >= least_estimate(percent)]
            first = np.argmax(keys[near] == keys[x], axis=1) == band if len(near) else np.empty(0, dtype=bool)
            found += [(g, x, y) for g, y in zip(guess[first], near[first])]
    return found, nodes, own.tolist()


def _worth_reading(table: pa.Table, percent: int) -> pa.Table:
    """Of one block pair, the nodes of likely pairs: only their texts are fetched."""
    found, nodes, _ = _likely(table.combine_chunks(), percent)
    used = sorted({x for _, *p in found for x in p})
    return table.select(["key", "i", "j", "node"]).take(pa.array(used, pa.int64()))


def _compare_blocks(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Links between the likely pairs of one block pair, by full sets. Pairs that links found here already join are skipped."""
    table = table.combine_chunks()
    found, nodes, own = _likely(table, percent)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets, out = _sets(table.column("text").combine_chunks(), size) if found else [], []
    for _, x, y in sorted(found, key=lambda f: -f[0]):
        if root(own[x]) != root(own[y]) and _similar(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]), percent):
            parent[root(own[x])] = root(own[y])
            out.append((nodes[x], nodes[y]))
    kind = table.schema.field("node").type
    return pa.table({"a": pa.array([a for a, _ in out], kind), "b": pa.array([b for _, b in out], kind)})


def _nodes(sig: DataFrame) -> DataFrame:
    """(node, digest, bands, planes, n): the smallest id of each class of equal sets."""
    return (sig.filter("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "bands", "planes", "n")).alias("r"))
            .select(F.col("r.id").alias("node"), "digest", "r.bands", "r.planes", "r.n"))


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Band rows (key, node), and the keys of two or more nodes with their smallest node."""
    bands = reps.select("node", F.explode("bands").alias("key"))
    return bands, bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")


def _block_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, component, block, i, j): members of candidate groups that aren't one component, once for each pair of blocks they take part in."""
    known = members.filter("size > 2").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parts = known.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all")).filter("all > top.c")
    plan = parts.select("key", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).cast("int").alias("p"),
                        F.ceil(F.col("top.c") / BLOCK).cast("int").alias("q"))
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    return (known.join(plan, "key").withColumn("stray", F.col("component") != F.col("main"))
            .withColumn("block", F.when(F.col("stray"), F.pmod(spread, "p")).otherwise(F.col("p") + F.pmod(spread, "q")))
            .withColumn("other", F.explode(F.expr("sequence(0, if(stray, p + q, p) - 1)")))
            .select("key", "node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))


def _readers(placed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, node): for each block pair the members whose texts have to be read."""
    kind = reps.schema["node"].dataType.simpleString()
    return (placed.join(reps.drop("digest"), "node").groupBy("key", "i", "j")
            .applyInArrow(lambda t: _worth_reading(t, percent), f"key long, i int, j int, node {kind}"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are runs of other bytes than 0x20 and 0x09-0x0D, A-Z lowered. Equal sets are one class and enter as one node. In every
    candidate group, all members are compared with its smallest node first. Groups whose other members don't form one component after
    that are compared in blocks of bounded size, only across components, so no link that changes a component is left out and a large
    group of copies costs as many comparisons as it has members. Blocks hold set sizes and packed bits; texts are fetched only for the
    members of pairs that these don't exclude, so texts that merely share a template are never copied. Links are confirmed on full sets.

    Null, empty and blank texts have no shingles and are linked with nothing. A text of fewer words than a shingle is one shingle.
    Rows that repeat an id and text repeat the result. Two texts under one id are told apart, but are one node if that id is the smallest of both
    classes. A null id is never linked: component_id is null and kept true. Other columns are ignored. No rows give no rows.
    """
    ship(docs.sparkSession)
    rows = pick(docs, id=id_col, text=text_col)
    sig = cut_lineage(signatures(rows, size))
    texts = rows.filter("id is not null and text is not null")
    reps = cut_lineage(_nodes(sig))
    bands, buckets = _candidates(reps)
    buckets = cut_lineage(buckets)
    members = cut_lineage(bands.join(buckets, "key").filter("node != leader"))
    low = least_estimate(percent)
    side = lambda s: reps.select(F.col("node").alias(s), F.col("digest").alias(f"{s}_digest"), F.col("planes").alias(f"{s}_planes"), F.col("n").alias(f"{s}_n"))
    sizes_fit = F.lit(100) * F.least("a_n", "b_n") >= F.lit(percent) * F.greatest("a_n", "b_n")
    text = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"{s}_text"))
    likely = (members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
              .filter(sizes_fit & (estimate("a_planes", "b_planes") >= low)).drop("a_planes", "b_planes", "a_n", "b_n"))
    kind = sig.schema["id"].dataType.simpleString()
    links = cut_lineage(likely.join(text("a"), "a").join(text("b"), "b").mapInArrow(lambda b: _confirm(b, size, percent), f"a {kind}, b {kind}"))
    labels = connected(links, "a", "b")

    placed = cut_lineage(_block_pairs(members, labels))
    asked = cut_lineage(_readers(placed, reps, percent))
    needed = asked.select(F.col("node").alias("id")).distinct()
    full = texts.join(reps.withColumnRenamed("node", "id"), "id").join(needed, "id", "left_semi")
    full = full.mapInArrow(lambda b: _own_text(b, size), full.schema).withColumnRenamed("id", "node").dropDuplicates(["node", "digest"])
    more = (placed.join(asked, ["key", "i", "j", "node"], "left_semi").join(full, "node").groupBy("key", "i", "j")
            .applyInArrow(lambda t: _compare_blocks(t, size, percent), f"a {kind}, b {kind}"))
    more = cut_lineage(more)
    if more.take(1):
        labels = connected(links.union(more), "a", "b")
    classes = reps.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sig.select("id", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _own_text(batches, size: int):
    """Only rows whose text has the expected set; an id may come with several texts."""
    for batch in batches:
        keep = [_digest(x) == d for x, d in zip(_sets(batch.column("text"), size), batch.column("digest").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))

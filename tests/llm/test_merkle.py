import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabsift.llm.merkle import Block, checked, field_digest, folded, manifest, parent
from tabsift.llm.structure_queries import FIELDS, witnessed


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][k:k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def _path(levels, at, arity):
    for nodes in levels[:-1]:
        first = at - at % arity
        yield at % arity, [d for k, d in enumerate(nodes[first:first + arity], first) if k != at]
        at //= arity


def _field(v):
    v = None if v is None else str(v)
    return "-" if v is None else f"{len(v.encode())}:{v}"


def _plain(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows, level by level."""
    groups = defaultdict(list)
    for r in rows:
        leaf = _h(*map(_field, r))
        text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, _h(*map(_field, (*r[:4], text))), r[0]))
    trees = {g: _levels([x[2] for x in sorted(rows, key=lambda x: x[:3])], arity) for g, rows in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = _levels([trees[g][-1][0] for g in order], arity)
    for g, rows in groups.items():
        for at, (_, _, leaf, found, doc_id) in enumerate(sorted(rows, key=lambda x: x[:3])):
            proof, now = "", found
            for place, siblings in [*_path(trees[g], at, arity), *_path(top, order.index(g), arity)]:
                proof += "".join(siblings)
                now = _h(*siblings[:place], now, *siblings[place:])
            yield doc_id, leaf, trees[g][-1][0], top[-1][0], _h(proof), now, now == top[-1][0]


def test_appends_give_the_tree_of_any_size():
    for n in range(1, 60):
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        block = Block(3)
        for leaf in leaves:
            block.append(leaf)
        levels = _levels([d.hex() for d in leaves], 3)
        root = block.close(None)
        assert root.hex() == levels[-1][0]
        for k, (leaf, w) in enumerate(zip(leaves, block.witnesses)):
            assert folded(leaf, bytes(w)) == root
            assert folded(parent([leaf]), bytes(w)) != root or n == 0
            assert sum(1 for _ in _path(levels, k, 3)) == len(levels) - 1


@pytest.mark.parametrize("height", [1, 2, 7])
def test_blocks_of_any_height_give_the_same(spark, height):
    """Groups of one to 100 leaves, one of them hot; nulls, empty texts, repeated rows, bytewise order of groups."""
    rows = [(k, "hot", "en", 3, f"a\nb{k}") for k in range(100)]
    rows += [(1000 + 10 * g + k, s, None, None, None if k == 2 else "" if k == 3 else "x\n") for g, s in enumerate(["a", "b", None, "é", "\U0001F600", "", "B", "z" * 300]) for k in range(g + 1)]
    rows += [(5, "hot", "en", 3, "again")] * 3 + [(None, "a", "en", 1, "q\n"), (None, None, None, None, None)]
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    both = df.select("doc_id", "source", field_digest(*names).alias("leaf"), F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")).alias("text"), "lang", "n_chars")
    both = both.select("doc_id", "source", "leaf", field_digest(*names).alias("found"))
    both = both.select("*", *(F.lit("clash").alias(c) for c in ("a.b", "grp", "rank", "n", "block", "witness", "root", "part", "tie", "proof_sha256", "above", "digest")))
    out = checked(manifest(both, "leaf", "source", ["doc_id"], height=height), "found")
    found = [(r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256, r.folded_root, r.folded_root == r.root.hex()) for r in out.collect()]
    assert sorted(found, key=repr) == sorted(_plain(rows), key=repr)


def test_one_leaf_text_ids_and_no_rows(spark):
    df = spark.createDataFrame([("x", "s", "hi")], "id string, grp_name string, text string")
    rows = df.select("id", "grp_name", field_digest("id", "text").alias("leaf"))
    one = manifest(rows, "leaf", "grp_name", ["id"]).collect()
    assert len(one) == 1 and one[0].root == one[0].subroot == one[0].leaf and one[0].witness == b""
    assert manifest(rows.limit(0), "leaf", "grp_name", ["id"]).collect() == []


def test_whole_table_against_levels(spark, folder, documents):
    found = [tuple(r) for r in witnessed(spark, folder).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    expected = list(_plain([tuple(r[c] for c in FIELDS) for r in documents.collect()]))
    assert sorted(found) == sorted(expected)
    assert {True, False} == {r[-1] for r in found}

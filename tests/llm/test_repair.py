import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabsift.llm import audit as A
from tabsift.llm.repair import damaged, repair
from tabsift.llm.structure_queries import repaired

LEGAL = re.compile(r"(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def _every_audit(rows):
    """(cost, audit, lines) of the cheapest, then least of all edit strings; rows are (role, text, forced, truncated)."""
    found = None
    slots = len(rows) + 1
    for inserts in itertools.product([(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")], repeat=slots):
        if sum(map(len, inserts)) > 3:
            continue
        for edits in itertools.product("KDua", repeat=len(rows)):
            cost, text, lines = 0, "", []
            for k in range(slots):
                for role in inserts[k]:
                    cost, text = cost + 3, text + "I"
                    lines.append((role, ""))
                if k == len(rows):
                    break
                role, body, forced, truncated = rows[k]
                if edits[k] == "D":
                    cost, text = cost + 4, text + "D"
                    continue
                if forced:
                    cost = 10_000
                    break
                new = {"K": role, "u": "user", "a": "assistant"}[edits[k]]
                cost, text = cost + (0 if edits[k] == "K" else 3) + (3 if truncated else 0), text + ("K" if edits[k] == "K" else "R")
                lines.append((new, body))
            if cost < 10_000 and LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (found is None or (cost, text) < found[:2]):
                found = (cost, text, lines)
    return found


def _greedy(rows):
    """(cost, audit) by the least cost of what follows: at each place the least letter that still gives the least cost."""
    turned, kept = {0: 2, 1: 2, 2: 3, 3: 2}, A.KEPT
    follow = [None] * (len(rows) + 1)
    follow[-1] = {0: 0, 1: 6, 2: 3, 3: 0}

    def moves(k, s):
        role, _, forced, truncated = rows[k]
        yield "D", s, 4
        if not forced:
            stay = 3 if truncated else 0
            if (s, role[:1]) in kept:
                yield "K", kept[(s, role[:1])], stay
            yield "R", turned[s], stay + 3

    for k in range(len(rows) - 1, -1, -1):
        here = {s: min(c + follow[k + 1][t] for _, t, c in moves(k, s)) for s in range(4)}
        for _ in range(3):
            here = {s: min(here[s], 3 + here[turned[s]]) for s in range(4)}
        follow[k] = here
    out, s, k = "", 0, 0
    while k < len(rows):
        left = follow[k][s]
        options = [(a, t, 1) for a, t, c in moves(k, s) if c + follow[k + 1][t] == left]
        if 3 + follow[k][turned[s]] == left:
            options.append(("I", turned[s], 0))
        letter, s, step = min(options)
        out, k = out + letter, k + step
    return follow[0][0], out + "I" * {0: 0, 1: 2, 2: 1, 3: 0}[s]


def _draw(rng, n):
    return [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), "t.", rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_the_programme_finds_the_least_of_all_audits():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4):
        for _ in range(6 if n < 4 else 2):
            rows = _draw(rng, n)
            cost, text, _ = _every_audit(rows)
            items = [A.Row(r[0][:1], r[2], r[3]) for r in rows]
            assert A.best(items)[::2] == (cost, text) == _greedy(rows)


@pytest.mark.parametrize("modulus", [A.MODULUS, 1, 7])
def test_colliding_hashes_change_nothing(modulus):
    rng = random.Random(2)
    for n in (5, 17, 64, 200):
        for _ in range(5):
            rows = _draw(rng, n)
            assert A.best([A.Row(r[0][:1], r[2], r[3]) for r in rows], modulus=modulus)[::2] == _greedy(rows)


def _plain(conversations):
    """conv -> result of damaged rows, without Spark."""
    out = {c: [] for c, *_ in conversations}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    results = {}
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        counts, seen, items = [0, 0, 0], set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults = [not bare, (role, text) in seen, bare[-1:] not in (".", "!", "?")]
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
            items.append((role, text, faults[0] or faults[1], faults[2]))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, text = _greedy(items)
        state, at, lines = 0, 0, []
        for letter in text:
            if letter == "I":
                state = A.TURNED[state]
                lines.append(A.ROLES[state] + ":")
                continue
            if letter == "K":
                state = A.KEPT[(state, items[at][0][:1])]
                lines.append(items[at][0] + ":" + items[at][1])
            elif letter == "R":
                state = A.TURNED[state]
                lines.append(A.ROLES[state] + ":" + items[at][1])
            at += 1
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        results[conv] = (gaps, *counts, illegal, cost, text, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return results


def _rows(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Fine.", "No end", "", " \n", "What?", "Yes!  \t", "Fine.", "é.", "Two.\nlines", None, "."]
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    return rows


def _results(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_blocks_of_any_size_give_the_same(spark, block):
    """Nulls everywhere, repeated turns and rows, empty roles, a conversation with a third of all rows."""
    rows = _rows(3, 40) + [(7, k, "user" if k % 3 else "assistant", f"Line {k % 17}." if k % 5 else "cut") for k in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("rank", F.lit(0)).withColumn("a.b", F.lit(0)).repartition(5)
    out = repair(damaged(df), present_col="present", block_rows=block)
    assert out.count() == 41
    assert _results(out) == _plain(rows)


def test_long_texts_go_block_by_block(spark, long_text):
    rows = [(1, 0, "user", long_text + "."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hm."), (2, 5, "user", long_text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _results(repair(damaged(df), present_col="present", whole_bytes=1000)) == _plain(rows)


def test_conversations_without_rows_and_empty_tables(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert _results(repair(damaged(df), present_col="present")) == {dropped: (0, 0, 0, 0, 0, 0, "", NOTHING)}
    assert repair(damaged(df.limit(0)), present_col="present").collect() == []
    text = spark.createDataFrame([("c", 0, "user", "Hi."), ("c", 1, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit, r.cost) for r in repair(text).collect()] == [("c", "KK", 0)]


def test_whole_table_against_plain(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = _results(repaired(spark, folder))
    assert found == _plain(rows)
    assert len(found) == len({r[0] for r in rows}) and {"D", "I", "K", "R"} <= set("".join(r[6] for r in found.values()))
    by = defaultdict(int)
    for r in found.values():
        for k in range(5):
            by[k] += r[k]
    assert all(by[k] for k in (1, 2, 3, 4))

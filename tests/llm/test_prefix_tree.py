"""The conversation trie against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeloom.llm import prefix_tree as P

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, part string, place string, words string, owner string, parent string"
ORDER = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)


def brute(rows, every=20, branches=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % branches
        base = int(c - (abs(c) % every) * (1 if c >= 0 else -1))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(nodes[path]) - 1) * words + sum(saved[k] for k in children[path])
    ends = defaultdict(list)
    for c, turns in whole.items():
        ends[turns].append(c)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in nodes.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*ORDER).collect())


def queried(spark, rows, monkeypatch):
    df = frame(spark, rows)
    monkeypatch.setattr(P, "table", lambda *_: df)
    return got(P.op12_prefix_tree(spark, ""))


def test_whole_table_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(P.op12_prefix_tree(spark, SF)) == brute(rows)


@pytest.mark.parametrize("step", [2, 64])
def test_hard_rows(spark, monkeypatch, step):
    monkeypatch.setattr(P, "STEP", step)
    rows = [(c, t, "user", f"turn {t} of  many") for c in range(-25, 45, 3) for t in range(c % 7)]
    rows += [(100 + n, t, "user", "same") for n in range(9) for t in range(n)]  # each begins the next: chains hang by chains
    rows += [(200, 1, None, None), (200, 1, "", ""), (200, None, "system", "first"), (200, 1, "user", "tie b"), (200, 1, "user", "tie a"), (200, 1, "user", "tie a")]
    rows += [(220 + n, t, "user", "copy" if t < 5 else None) for n in range(15) for t in range(6)]
    rows += [(None, 1, "user", "no id"), (-3, 1, "user", "a\tb\x0cc\x00 d e")]
    rows += [(300, t, "user", f"long {t // 3}") for t in range(150)] + [(320, t, "user", f"long {t // 3}" if t < 131 else "other") for t in range(140)]
    # rows of one number are ordered by a hash of the text: here by the operator's own order
    firm = [r for r in rows if r[0] != 200]
    assert queried(spark, firm, monkeypatch) == brute(firm)
    assert len(queried(spark, rows, monkeypatch)) == len(brute(rows))


def test_no_rows(spark, monkeypatch):
    assert queried(spark, [], monkeypatch) == []
    assert queried(spark, [(None, 1, "user", "x")], monkeypatch) == []


def test_conversations_without_turns(spark):
    turns = spark.createDataFrame([(5, 1, 1, 1, 3), (6, 1, 1, 1, 3)], "conv_id bigint, d bigint, t1 bigint, t2 bigint, words bigint")
    conversations = spark.createDataFrame([(4, 0), (5, 1), (6, 1), (7, 0)], "conv_id bigint, length bigint")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got(P.tree(turns, conversations)) == [(4, 0, -1, 4, 1, 1, 3, sha("4,7")), (5, 1, 4, 2, 0, 1, 3, sha("5,6"))]


def test_pieces_of_a_list_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 7)
    ends = spark.range(1000).select((F.col("id") % 3).alias("node"), F.lit(2).cast("bigint").alias("depth"), F.col("id").alias("conv_id")).repartition(9)
    found = {r.node: r.sha for r in P.ends_hashed(ends).collect()}
    assert found == {k: hashlib.sha256(",".join(str(i) for i in range(k, 1000, 3)).encode()).hexdigest() for k in range(3)}

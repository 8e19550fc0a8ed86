import math
import struct
import zlib
from collections import Counter

import xxhash

from bunkerline.llm import hashtree
from bunkerline.llm.queries import QUERIES


def draw(key, node):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    u = ((xxhash.xxh64_intdigest(node.name.encode(), seed) >> 11) + 0.5) / 2**53
    return -math.log(u) / node.weight


def descend(key, node):
    while node.children:
        node = min((c for c in node.children if c.weight > 0), key=lambda c: draw(key, c))
    return node.shard


def test_query_against_brute_force(spark, small_dir):
    rows = QUERIES["op9_hash_tree"](spark, small_dir).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    now, grown = hashtree.topology(24), hashtree.topology(25)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 8, zlib.crc32(docs[r["doc_id"]]))
        assert (r["shard"], r["grown_shard"]) == (descend(r["doc_id"], now), descend(r["doc_id"], grown))
        assert r["grown_shard"] in (r["shard"], 24)
    for s in range(24):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_shares_and_confined_movement(spark):
    keys = spark.range(60000).withColumnRenamed("id", "k")
    N = hashtree.Node
    tree = lambda w: N("root", 1, (N("a", 2, (N("a0", 1, shard=0), N("a1", w, shard=1), N("off", 0, shard=9))), N("b", 1, shard=2)))
    rows = hashtree.assign(hashtree.assign(keys, tree(1), "k", "x"), tree(3), "k", "y").collect()
    share = Counter(r["x"] for r in rows)
    assert all(abs(share[s] / 60000 - 1 / 3) < 0.01 for s in (0, 1, 2)) and 9 not in share
    assert {(r["x"], r["y"]) for r in rows} == {(0, 0), (0, 1), (1, 1), (2, 2)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (3, None, 2), (3, None, 2)], "doc_id long, base string, task int")
    out = hashtree.number(hashtree.assign(df, hashtree.topology(24), "doc_id")).collect()
    assert len(out) == 4 and len({(r["shard"], r["slot"]) for r in out}) == 4
    assert hashtree.number(hashtree.assign(df.limit(0), hashtree.topology(3), "doc_id")).count() == 0

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from filamenta.llm import threshold_search as ts

DOCS = "doc_id long, text string, term string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, queries, k):
    """Every document scored for every query, by the definition."""
    rows = [(key, terms(text)) for key, text in docs]
    rows = [(key, t) for key, t in rows if t]
    n, total = len(rows), sum(len(t) for _, t in rows)
    df = {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ask in asked.items():
        found = []
        for key, t in rows:
            m = 100 - 50 + (50 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in ask if x in t)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, queries, k, **kw):
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], DOCS)
    q = spark.createDataFrame([(a, b, 7) for a, b in queries], "item_id long, text string, score int")
    out = ts.search(d, q, k, **kw)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "A-b", "x_y", "1.5"]
    pick = lambda size: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=size))
    return [(i, pick(rng.choice([1, 5, 20, 80]))) for i in range(n)], [(i, pick(12)) for i in range(6)]


@pytest.mark.parametrize("shard, block", [(1 << 19, 8 << 20), (300, 600)])
def test_equals_every_document_scored(spark, shard, block):
    docs, queries = corpus(1, 300)
    docs += [(5, docs[5][1]), (None, docs[7][1]), (300, None), (301, ""), (302, " \n-_")]
    queries += [(50, None), (51, "nowhere"), (0, "W1 w1 w59"), (None, "日本 w3")]
    assert found(spark, docs, queries, 10, shard=shard, block=block) == plain(docs, queries, 10)


def test_a_hot_text_ties_and_fewer_than_k(spark):
    docs = [(i, "one and the same text") for i in range(200, 0, -1)] + [(0, "another text")]
    assert found(spark, docs, [(1, "text same"), (2, "another")], 50) == plain(docs, [(1, "text same"), (2, "another")], 50)


def test_empty_tables_and_a_very_long_text(spark):
    assert found(spark, [], [(1, "a")], 5) == [] and found(spark, [(1, "a b")], [], 5) == []
    docs = [(1, "long word " * 200_000 + "rare"), (2, "word"), (3, "other")]
    assert found(spark, docs, [(1, "rare word")], 5) == plain(docs, [(1, "rare word")], 5)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    n, lists, forward = 20_000, [], np.zeros((3, 20_000), np.int64)
    for j in range(3):
        forward[j] = rng.integers(1, 1000, n)
        forward[j, :20] = 5000 + np.arange(20)
        order = np.argsort(-forward[j], kind="stable").astype(np.int32)
        lists.append((order, forward[j][order].astype(np.int32)))
    read = []

    def scores_of(docs):
        read.append(len(docs))
        return forward[:, docs].sum(0)

    best = ts.threshold_top(lists, [1, 1, 1], n, scores_of, [], int, 10)
    assert [b[2] for b in best] == list(range(19, 9, -1)) and sum(read) < 500


def test_stops_only_strictly_below_the_kth_score():
    docs = np.array([9, 3, 1], np.int32)
    lists = [(docs, np.array([4, 4, 4], np.int32))]
    assert [b[2] for b in ts.threshold_top(lists, [1], 10, lambda d: np.full(len(d), 4), [], int, 1, step=1)] == [1]


def test_a_row_group_holds_few_shards(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} common") for i in range(300)], "doc_id long, text string").coalesce(1)
    shards, _ = ts.index(docs, shard=60)
    sizes = [m.row_group(g).num_rows for f in shards.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in range(m.num_row_groups)]
    assert sum(sizes) == shards.count() > 10 and max(sizes) <= ts.GROUP

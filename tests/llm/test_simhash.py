import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from filamenta.llm import simhash
from filamenta.operators.graph import connected_components


def brute_components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_definition_and_spark_hash(spark):
    texts = [None, "", "  \t", "One", "one TWO", "a b c", "Ä b\x0bc d É f g", " ".join(map(str, range(700)))]
    assert [simhash.fingerprint(simhash.words_of(t)) for t in texts] == [brute_fingerprint(t) for t in texts]
    assert spark.range(1).select(F.xxhash64(F.lit("Ä b c"))).first()[0] % 2**64 == xxh64_intdigest("Ä b c".encode(), 42)


def test_trie_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = [base]
    for _ in range(4):
        fp.append(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)))
    fp = np.unique(np.concatenate(fp))
    for budget, lot in ((0, 1 << 19), (1, 7), (2, 50), (6, 40)):
        i, j = simhash.trie_pairs(np.zeros(len(fp), np.int64), fp, budget, lot)
        want = {(a, b) for a, b in combinations(range(len(fp)), 2) if bin(int(fp[a] ^ fp[b])).count("1") <= budget}
        got = list(zip(*(x.tolist() for x in (np.minimum(i, j), np.maximum(i, j))), strict=True))
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("budget", [2, 6])
def test_components_of_near_documents(spark, monkeypatch, budget):
    monkeypatch.setattr(simhash, "LIMIT", 5)  # forces every depth of division
    rng = random.Random(1)
    rows, fps = [], {}
    bases = [rng.getrandbits(64) for _ in range(6)] + [0]
    for n in range(260):
        x = rng.choice(bases)
        for _ in range(rng.randint(0, budget + 1)):
            x ^= 1 << rng.randrange(64)
        fps[n] = x
        rows.append((n, x - 2**64 if x >= 2**63 else x))
    classes = spark.createDataFrame(rows, "doc long, fp long").groupBy("fp").agg(F.min("doc").alias("doc"))
    found = {r.node: r.component for r in connected_components(simhash.near_links(classes, budget), "a", "b").collect()}
    want = brute_components([(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= budget], fps)
    first = {}
    for n, x in fps.items():
        first.setdefault(x, n)
    assert {n: found.get(first[x], first[x]) for n, x in fps.items()} == want


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text, 1), (3, text, 2), (9, None, 3), (8, "", 4), (7, " \n", 5), (None, "x", 6), (11, text + " end", 7), (3, text, 8), (20, "other words stand here", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicate_components(docs).collect())
    assert len(got) == len(rows) and (5, 3) in got and (9, 7) in got and (8, 7) in got and (-1, -1) in got and (20, 20) in got
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {7, 20, 3} <= {r.doc_id for r in kept.collect()}
    assert simhash.near_duplicate_components(docs.limit(0)).count() == 0


def test_near_copies_go_and_documents_that_share_a_passage_stay(spark):
    rng = random.Random(11)
    text = lambda n: [f"t{rng.randrange(5000)}" for _ in range(n)]
    rows, copies = [], set()
    for i in range(40):
        w = text(300)
        near = list(w)
        near[rng.randrange(300)] = "changed"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(near))]
        copies.add(1000 + i)
    passage = text(120)
    rows += [(2000 + i, " ".join(text(120) + passage)) for i in range(20)]
    docs = spark.createDataFrame([*rows, (None, "x"), (3000, None)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert {i for i, _ in rows} - kept <= copies and len(kept & copies) <= 4 and {None, 3000} <= kept


def test_chain_and_hub_components(spark):
    chain = [(i, i + 1) for i in range(50, 90)]
    hub = [(200, i) for i in range(201, 260)]
    edges = spark.createDataFrame([*chain, *hub, (7, 7), (None, 3), (1, 2), (2, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == brute_components([*chain, *hub, (1, 2)], [*range(50, 91), *range(200, 260), 1, 2])


def jaccard(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_alike_pairs_connect_what_brute_force_connects():
    rng = random.Random(5)
    for n in (2, 30, 120):
        base = [rng.getrandbits(60) for _ in range(60)]
        sets = [np.unique(np.array([x if rng.random() > rng.choice((0.02, 0.15, 0.3)) else rng.getrandbits(60) for x in base], np.uint64)) for _ in range(n)]
        alike = [(i, j) for i, j in combinations(range(n), 2) if len(s := np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and len(s)]
        assert brute_components(simhash.alike_pairs(sets, 0.8), range(n)) == brute_components(alike, range(n))


@pytest.mark.parametrize("lot", [4_000_000, 9000])
def test_one_of_each_component_of_verified_links_stays(spark, monkeypatch, lot):
    monkeypatch.setattr(simhash, "LOT", lot)  # the small one divides the group into several parts
    rng = random.Random(2)
    base = [f"t{rng.randrange(9000)}" for _ in range(400)]

    def edited(*at):
        w = list(base)
        for k in at:
            w[k] = f"edit{k}"
        return " ".join(w)

    start, steps = edited(*range(3, 63, 9)), [edited(*range(3, 63, 9), *range(130, 130 + 6 * n, 6)) for n in (6, 12, 18)]
    siblings = [edited(*range(3 + k, 123 + k, 18)) for k in range(1, 5)]
    rows = [(1, start), *enumerate(steps, 2), *enumerate(steps[-1:] * 2, 10), *enumerate(siblings, 20), (30, " ".join(base)), (31, "quite other words stand in this one"), (None, start)]
    texts = dict(rows)
    alike = [(a, b) for a, b in combinations([k for k in texts if k], 2) if jaccard(texts[a], texts[b]) >= 0.8]
    assert jaccard(start, steps[-1]) < 0.8 and any(jaccard(start, s) < 0.8 for s in siblings)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id or 0 for r in simhash.one_of_each(docs, budget=9).collect())
    assert kept == sorted({0, *brute_components(alike, [k for k in texts if k]).values()}) == [0, 1, 31]


def test_pairs_just_alike_are_found(spark):
    rng = random.Random(8)
    rows, alike = [], []
    for i in range(150):
        w = [f"t{rng.randrange(9000)}" for _ in range(300)]
        near = list(w)
        for at in rng.sample(range(0, 300, 5), 6):
            near[at] = "changed"
        rows += [(i, " ".join(w)), (1000 + i, " ".join(near))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            alike.append(1000 + i)
    assert len(alike) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert set(range(150)) <= kept and {1000 + i for i in range(150)} - kept <= set(alike)
    assert len(kept & set(alike)) <= 0.02 * len(alike)

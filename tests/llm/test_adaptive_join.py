import random

import numpy as np
import pytest

from filamenta.llm import adaptive_join as aj
from filamenta.llm import simhash

SCHEMA = "doc_id long, text string, n long, token string, same int"


def shingles(text, width=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(docs):
    """Every pair of rows compared."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[up(i)] = up(j)
    out = []
    for i, (k, _) in enumerate(docs):
        keys = [docs[j][0] for j in range(len(docs)) if up(j) == up(i) and docs[j][0] is not None]
        out.append((k, len(sets[i]), min(keys, default=None) if sets[i] else k))
    return sorted(out, key=str)


def found(spark, docs):
    out = aj.components(spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def corpus(seed):
    """Families of near copies at many similarities, a passage that many share, copies, and texts of a few words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            t = [word() if rng.random() < rng.choice([0, 0.005, 0.02, 0.05]) else x for x in base]
            texts.append(" ".join(t + passage * (rng.random() < 0.3)))
    texts += [" ".join([*passage, word(), word()]) for _ in range(90)] + ["one", "One", "one two", "a b c", "", " \t", None, "a\x0bb c", "A b\nc d", "a b c d"]
    return [(i if rng.random() > 0.02 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_pair_compared(spark, seed):
    docs = corpus(seed)
    docs += [(docs[3][0], docs[40][1]), (7, docs[60][1])]  # keys that repeat with another text
    assert found(spark, docs) == plain(docs)


def test_a_world_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOT", 4000)
    docs = corpus(3)
    assert found(spark, docs) == plain(docs)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(400):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(t)))
    assert {r[2] for r in found(spark, docs)} == {0}


def test_empty_table_and_a_very_long_text(spark):
    assert found(spark, []) == []
    rng = random.Random(5)
    long = [str(rng.randrange(10**6)) for _ in range(300_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:150_000], "z", *long[150_001:]])), (3, " ".join(long[:200_000]))]
    assert [r[2] for r in found(spark, docs)] == [1, 1, 3]


@pytest.mark.parametrize("seed", range(6))
def test_multi_match_connects_what_all_pairs_connect(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(5000, rng.integers(1, 60), replace=False)
        for _ in range(rng.integers(1, 8)):
            keep = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1])]
            sets.append(np.unique(np.r_[keep, rng.choice(5000, rng.integers(0, 4))]).astype(np.uint64))
    sets = [s for s in sets if len(s)]
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    df = dict(zip(token.tolist(), count.tolist(), strict=True))
    ordered = [np.array(sorted((t for t in s.tolist() if df[t] > 1), key=lambda t: (int(np.log2(df[t])), t)), np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    own = n - np.array([len(o) for o in ordered])
    asked = np.array([rng.integers(1, max(2, min(len(o), int(aj.least_shared(k, 85))) + 1)) if len(o) else 1 for o, k in zip(ordered, n, strict=True)])
    pairs = aj.multi_match(n, own, asked, ordered, np.arange(len(sets)))

    def roots(links):
        root = np.arange(len(sets))
        for i, j in links:
            root[root == max(root[i], root[j])] = min(root[i], root[j])
        return root.tolist()

    true = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert roots(pairs) == roots(true) and set(map(frozenset, pairs)) <= set(map(frozenset, true))


def test_asked_matches_follow_the_costs():
    level = np.full(200, 3, np.uint8)
    cheap, dear = aj.matches_asked(level, 30, 4), aj.matches_asked(level, 30, 4000)
    assert 1 <= cheap < dear <= 171
    level[40:] = 20  # longer prefixes would read long lists
    assert aj.matches_asked(level, 30, 4000) == 11


def test_packing():
    x = np.random.default_rng(0).integers(0, 1 << 56, 1000, dtype=np.uint64)
    assert (aj.unpacked(aj.packed(x)) == x).all() and len(aj.unpacked(b"")) == 0

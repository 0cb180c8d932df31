import math
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filamenta.llm import ngram_trie


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 200), st.integers(0, 200))
def test_elias_fano_round_trip(values, a, b):
    values = np.array(sorted(values), np.uint64)
    e = ngram_trie.EliasFano.of(values)
    assert (e.decode() == values).all()
    a, b = sorted((min(a, len(values)), min(b, len(values))))
    assert (e.decode(a, b) == values[a:b]).all()


def test_elias_fano_blocks(monkeypatch):
    monkeypatch.setattr(ngram_trie.EliasFano, "EVERY", 8)
    values = np.cumsum(np.random.default_rng(0).integers(0, 5, 300)).astype(np.uint64)
    e = ngram_trie.EliasFano.of(values)
    for a, b in ((0, 300), (7, 9), (8, 16), (15, 290), (299, 300), (5, 5)):
        assert (e.decode(a, b) == values[a:b]).all()


def test_trie_file_and_search(tmp_path):
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))
    node = np.sort(rng.integers(0, 50, 400))
    context = rng.integers(0, 30, 400).astype(np.uint64) * np.uint64(7919)
    keys = sorted(set(zip(node.tolist(), context.tolist(), strict=True)))
    node, context = np.array([k[0] for k in keys]), np.array([k[1] for k in keys], np.uint64)
    value = rng.normal(size=len(keys))
    ngram_trie.Trie.build(words, np.arange(50) + 1, node, context, value).write(str(tmp_path / "t"))
    t = ngram_trie.Trie.open(str(tmp_path / "t"))
    asked = sorted({*keys, *((int(a), int(b) * 7919) for a, b in rng.integers(0, 40, (300, 2)))} | {(-1, 7919)})
    for block in (1, 16, 1 << 20):
        got = t.find(np.array([a for a, _ in asked]), np.array([b for _, b in asked], np.uint64), block)
        want = np.array([value[keys.index(k)] if k in keys else np.nan for k in asked])
        assert np.allclose(got, want, atol=1e-4, equal_nan=True)
    n, c = t.find_words(np.r_[words[:3], np.uint64(5)])
    assert n.tolist() == [0, 1, 2, -1] and c.tolist() == [1, 2, 3, 0]


def _brute(docs, held):
    words = {i: [*(t or "").encode().lower().split(), b" </s>"] for i, (_, t) in enumerate(docs)}
    c, pairs = Counter(), Counter()
    for i, w in words.items():
        if not held[i]:
            c.update(w)
            pairs.update(zip([b" <s>", *w], w, strict=False))
    n, once = sum(c.values()), sum(x == 1 for x in c.values())
    u, m = (once + 1) / (n + once + 2), ngram_trie.M
    out = []
    for i, w in words.items():
        base = sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in w)
        score = 0.0
        for v, x in zip([b" <s>", *w], w, strict=False):
            cv = c[b" </s>"] if v == b" <s>" else c[v]
            p = (1 - u) * c[x] / n if c[x] else u
            score += math.log10((pairs[v, x] + m * p) / (cv + m))
        out.append((docs[i][0], held[i], len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_trie, "BATCH_DOCS", 17)
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 900)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["a", "B", "ccc", "ñ", "the"]) if rng.random() < 0.6 else f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(500, None), (501, " \t"), (502, "hot pair " * 4000), (3, docs[3][1]), (None, "no key")]
    frame = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, score double, shard string").repartition(3)
    cond = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    held = [d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 2 for d in docs]
    key = lambda r: (r[0] is None, r[0], r[2])
    got, want = sorted(map(tuple, ngram_trie.scored(frame, cond).collect()), key=key), sorted(_brute(docs, held), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-3 * max(1, w[2] ** 0.5) + 1e-5 * w[2]
    assert ngram_trie.tries(frame, cond).count() > 1
    assert ngram_trie.scored(frame.limit(0), cond).count() == 0
    assert [r.n_known for r in ngram_trie.scored(frame.where("doc_id = 1"), F.lit(True)).collect()] == [0]


def test_levels_are_searched_once_for_many_blocks_and_only_touched_documents_return(monkeypatch):
    packed, busy = [], {ngram_trie._hash(w) % 8 for w in (ngram_trie.END, b"common")}
    shard = min(set(range(8)) - busy)
    for b in range(30):
        batch = ngram_trie._Batch()
        for d in range(40):
            batch.add(d, d % 7 == 2, f"common w{b * d % 50} only{b}x{d}")
        packed += [blob for s, blob in batch.blocks(8) if s == shard]
    trie, triples, words, contexts = ngram_trie._shard_trie(packed, 4000, 0.01, ngram_trie.M)
    calls, find = [], ngram_trie.Trie.find
    monkeypatch.setattr(ngram_trie.Trie, "find", lambda self, *a: calls.append(1) or find(self, *a))
    whole = [ngram_trie._unpack(x) for x in ngram_trie._score_blocks(trie, triples, words, contexts, 4000, 0.01, ngram_trie.M)]
    assert len(calls) == 1 and len(whole) == len(packed)
    assert all(len(docs) == len(known) == len(score) == len(base) == len(set(t[2].tolist())) for (docs, known, score, base), t in zip(whole, triples, strict=True))
    assert sum(len(w[0]) for w in whole) < 30 * 40
    monkeypatch.setattr(ngram_trie, "LOT", 1)
    for one, other in zip(whole, ngram_trie._score_blocks(trie, triples, words, contexts, 4000, 0.01, ngram_trie.M), strict=True):
        assert all((a == b).all() for a, b in zip(one, ngram_trie._unpack(other), strict=True))

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from filamenta.llm import toxicity

PLAIN = ["river", "stone", "walk", "green", "letter", "winter", "table", "music", "open", "slow"]


def _text(rng, bad):
    words = [rng.choice(PLAIN) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(20, 80))]
    for _ in range(3 if bad else 0):
        words[rng.randrange(len(words))] = rng.choice(["grobnik", "vileword", "grobnaz"])
    return " ".join(words)


def test_held_out_accuracy_rare_forms_and_edge_cases(spark):
    rng = random.Random(2)
    rows = [(i, _text(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(1000, None, 1.0), (1001, "", 1.0), (1002, "plain " * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(3, None), (None, 1), (7, 0), (7, 0)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    wrong = [i for i, _, y in rows if i % 4 == 0 and (got[i] >= 0.5) != y]
    assert len(got) == 403 and len(wrong) <= 2 and max(got[1000], got[1001], got[1002]) < 0.5
    model = toxicity.unpacked(model)
    rude, kind = toxicity.scores(model, pa.array(["table " * 20 + "vileword " + "walk " * 20, "table " * 20 + "walker " + "walk " * 20]))
    assert rude > 0.5 > kind
    kept = toxicity.without_toxic(docs, toxicity.fitted(docs, labels))
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {9.0, 1.0}


def test_without_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert [r.score for r in toxicity.scored(docs, model).collect()] == [0.25]
    assert toxicity.scored(docs.limit(0), model).agg(F.count("*")).first()[0] == 0


def _discount(counts):
    n1, n2 = (sum(c == k for c in counts) for k in (1, 2))
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _brute(docs, toxic):
    """P(w | v) of either class by dictionaries, straight from the definition; "<s>" starts a text."""
    words = {w for d in docs for w in d}
    triples = [set(), set()]
    for d, t in zip(docs, toxic):
        d = ["<s>", *d]
        triples[t] |= {((d[k - 2], d[k - 1]) if k > 1 else None, d[k - 1], d[k]) for k in range(1, len(d))}
    pairs = [Counter((v, w) for _, v, w in t) for t in triples]
    shared_word = {w: sum(any(b == w for _, b in p) for p in pairs) for w in words}
    shared_pair = Counter(x for p in pairs for x in p)

    def level(counts, below):
        total = sum(counts.values())
        if not total:
            return below
        d = _discount(list(counts.values()))
        left = d * sum(n > 0 for n in counts.values()) / total
        return lambda w: max(counts.get(w, 0) - d, 0) / total + left * below(w)

    def models(c):
        follow = Counter(w for _, w in pairs[c])
        own = level(follow, level(shared_word, lambda w: 1 / (len(words) + 1)))

        def after(counts, d, v, below):
            mine = {w: n for (a, w), n in counts.items() if a == v}
            total = sum(mine.values())
            return below if not total else lambda w: max(mine.get(w, 0) - d, 0) / total + d * len(mine) / total * below(w)

        return lambda v, w: after(pairs[c], _discount(list(pairs[c].values())), v, after(shared_pair, _discount(list(shared_pair.values())), v, own))(w)

    return [models(0), models(1)], words


def test_models_against_brute_force():
    rng = random.Random(4)
    docs = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(0, 30))] for _ in range(24)]
    toxic = [int(k % 3 == 0) for k in range(24)]
    (ordinary, mean), words = _brute(docs, toxic)
    names, word, ends = toxicity.coded(pa.array([" ".join(d) for d in docs]))
    hashed = toxicity.hashes(names)
    models = toxicity.Models(np.searchsorted(np.sort(hashed), hashed)[word], ends, np.array(toxic), np.sort(hashed))
    for v in ["<s>", "ax", "gz"]:
        for p in (ordinary, mean):
            assert abs(sum(p(v, w) for w in words) + p(v, "?") - 1) < 1e-9
    texts = [["ax", "unseen", "by", "by", "cz"], ["hz"], [], docs[0], docs[1]]
    own, asked, stops = toxicity.coded(pa.array([" ".join(t) for t in texts]))
    got = models.evidence(models.numbers(toxicity.hashes(own))[asked], stops)
    for row, t in zip(got, texts):
        ratios = [math.log(mean(v, w) / ordinary(v, w)) for v, w in zip(["<s>", *t], t)]
        assert abs(row[0] - (sum(ratios) / len(ratios) if t else 0)) < 1e-5
        assert abs(row[1] - max(ratios, default=0)) < 1e-5
        assert abs(row[2] - (max(sum(ratios[k : k + 4]) for k in range(max(1, len(t) - 3))) / 4 if t else 0)) < 1e-5

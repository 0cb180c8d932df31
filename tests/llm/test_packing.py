import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from filamenta.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack_keeps_every_item_and_fits(lengths):
    bins = packing.pack(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 64))


def test_search_empties_bins():
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best fit takes three bins of 60; the search must not take more
    bins = packing.local_search([[0], [1, 2], [3, 4], [5, 6, 7], [8, 9]], lengths, 60)
    assert sorted(i for b in bins for i in b) == list(range(10)) and all(sum(lengths[i] for i in b) <= 60 for b in bins)
    assert len(bins) == 3


def test_search_never_worse_on_hard_items():
    rng = random.Random(3)
    for _ in range(20):
        lengths = [rng.randint(20, 50) for _ in range(120)]
        assert len(packing.pack(lengths, 100)) <= len(packing.best_fit(lengths, 100))


def test_packed_documents_round_trip(spark):
    texts = [None, "", " \n", "Plain words, here; it's 2 o'clock", "Straße ÉCOLE été ΣΑΣ İ", "a<|endoftext|>b <|startoftext|>", "x\x1cy z w v", "lang " * 9000, "tie tie", "tie tie"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no key", 1, "y")], "doc_id long, text string, length int, piece string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.packed_documents(docs).collect()
    bins: dict[int, list] = {}
    for i, t in [*enumerate(texts), (None, "no key")]:
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(want) // 4096)))
        for r in mine:
            part = want[r.start : r.start + 4096]
            assert r.start == 4096 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_equal_rows_are_dealt_to_many_shards(spark):
    rows = spark.createDataFrame([(1, 0, 0, 100, 7)] * 2000, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    shards = {}
    for r in packing._pack_shards(rows, 4096, 8, 0).collect():
        shards[r.sequence_id >> 28] = shards.get(r.sequence_id >> 28, 0) + 1
    assert len(shards) == 8 and max(shards.values()) < 400
    full = packing.packed(rows.where("length > 0"), 4096, shard=250)
    assert full.count() == 2000 and full.select("sequence_id").distinct().count() == 50


def test_search_is_whole_on_many_bins():
    rng = random.Random(5)
    lengths = [rng.randint(1024, 2048) for _ in range(1500)]
    bins = packing.pack(lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and len(bins) < 0.97 * len(packing.best_fit(lengths, 4096))
    spare = len(bins) - -(-sum(lengths) // 4096)
    lows = sorted(bins, key=lambda b: sum(lengths[i] for i in b))[:spare]
    fills = [sum(lengths[i] for i in b) for b in bins]
    for low in lows:  # no move or one-for-one exchange is left
        for high, fill in zip(bins, fills, strict=True):
            if high is not low and fill < 4096 and fill >= sum(lengths[i] for i in low):
                assert all(lengths[i] - lengths[j] <= 0 or fill + lengths[i] - lengths[j] > 4096 for i in low for j in high)

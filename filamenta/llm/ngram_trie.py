"""Language-model scores by an Elias-Fano n-gram trie.

Model. Tokens are words between ASCII white space, A-Z lower-cased, then one end token; a text starts in a context of its
own. A word's probability is (1 - u) c / N, and u = (n1 + 1) / (N + n1 + 2) for the class of unknown words, with N
training tokens, n1 words that occur once. In context v it is smoothed towards that: (c(v w) + M P(w)) / (c(v) + M), which
sums to one. Its logarithm is a sum of one term of the pair and the word and one of the context alone, so a token's score
needs no table that holds every word: pairs live with their second word, and the context's term where the context is a
word itself.

Trie. Words go to shards by hash, in numbers that grow with the text. A shard's trie has a level of word hashes, exact
counts, monotone pointers into the level of contexts, and for every context its place in the shard's own context list. All
are Elias-Fano sequences: places are made monotone by adding the node before's last value, so that a context is found by
successor search relative to its node. The smoothed value of a pair is one of 65,536 quantised logarithms. Levels lie in
one file that is memory-mapped for the search.

Scale. Texts are counted in batches: a batch sends each shard one block with its distinct (word, context, document)
triples, for training and for scoring at once, in one exchange. A common word's or pair's occurrences are counted before
they move. Shards hold SHARD_TOKENS tokens on average; a shard's distinct pairs are looked up together, in lots of LOT
triples, and it sends back sums only for the documents of a batch that it has tokens of. Word hashes have 64 bits, contexts below a word 40 of them.
Only N, n1 and the like, three numbers, reach the driver.

A null or empty text is the end token alone. Repeated rows and keys are separate documents. Without training text every
word is unknown.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M = 1000.0
BATCH_TOKENS, BATCH_DOCS = 1 << 21, 1 << 12
SHARD_TOKENS = 2_000_000
#: Triples of a shard that are looked up at once.
LOT = 1 << 23
CONTEXT_MASK = np.uint64((1 << 40) - 1)
START, END = b" <s>", b" </s>"  # no word holds a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers: low bytes, and the rest in unary with sampled positions."""

    EVERY = 1 << 14

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.width, self.low, self.high, self.marks = n, width, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        width = -(-bits // 8)
        low = values.view(np.uint8).reshape(n, 8)[:, :width].copy()
        top = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        at = top + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, width, low, np.packbits(ones), at[:: cls.EVERY])

    def parts(self) -> list[np.ndarray]:
        return [self.low.reshape(-1), self.high, self.marks.astype("<i8")]

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Values start to stop; reading begins at the sampled position before."""
        stop = self.n if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint64)
        k = start // self.EVERY
        first = int(self.marks[k])
        end = stop // self.EVERY + 1
        last = int(self.marks[end]) if end < len(self.marks) else 8 * len(self.high)
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.high[byte : -(-(last + 1) // 8)])) + 8 * byte
        ones = ones[np.searchsorted(ones, first) :]
        i = np.arange(k * self.EVERY, k * self.EVERY + len(ones))
        top = (ones - i)[start - i[0] : stop - i[0]].astype(np.uint64)
        out = np.zeros((stop - start, 8), np.uint8)
        out[:, : self.width] = self.low[start:stop]
        return out.view(np.uint64).reshape(-1) | (top << np.uint64(8 * self.width) if self.width < 8 else np.uint64(0))


class Trie:
    """Words, their counts, and below each word its contexts with a quantised value."""

    def __init__(self, levels: dict, codes: np.ndarray, counts: np.ndarray, book: tuple[float, float]):
        self.levels, self.codes, self.counts, self.book = levels, codes, counts, book

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, node: np.ndarray, context: np.ndarray, value: np.ndarray) -> Trie:
        """words: sorted hashes; the rest by (node, context), distinct: node numbers words, context is a hash."""
        contexts = np.unique(context)
        place = np.searchsorted(contexts, context).astype(np.uint64) + np.uint64(1)
        pointers = np.searchsorted(node, np.arange(len(words) + 1)).astype(np.uint64)
        ends = pointers[1:].astype(np.int64) - 1
        last = np.where(np.diff(pointers.astype(np.int64)) > 0, place[np.maximum(ends, 0)] if len(place) else 0, 0).astype(np.uint64)
        base = np.concatenate(([np.uint64(0)], np.cumsum(last)))[:-1]
        levels = {"words": EliasFano.of(words), "contexts": EliasFano.of(contexts), "pointers": EliasFano.of(pointers), "places": EliasFano.of(place + base[node] if len(place) else place)}
        low, high = (float(value.min()), float(value.max())) if len(value) else (0.0, 0.0)
        step = (high - low) / 65535 or 1.0
        return cls(levels, np.round((value - low) / step).astype("<u2"), counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8"), (low, step))

    def write(self, path: str) -> None:
        """All levels in one file: a header, then the arrays one after the other."""
        arrays = [a for name in sorted(self.levels) for a in self.levels[name].parts()] + [self.codes, self.counts]
        head = pickle.dumps(([(name, self.levels[name].n, self.levels[name].width) for name in sorted(self.levels)], [(a.dtype.str, len(a)) for a in arrays], self.book))
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for a in arrays:
                f.write(np.ascontiguousarray(a).tobytes())

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file, its levels memory-mapped."""
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            names, kinds, book = pickle.loads(f.read(size))
        at, arrays = 8 + size, []
        for kind, n in kinds:
            arrays.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        levels = {}
        for k, (name, n, width) in enumerate(names):
            low, high, marks = arrays[3 * k : 3 * k + 3]
            levels[name] = EliasFano(n, width, low.reshape(n, width), high, marks)
        return cls(levels, arrays[-2], arrays[-1], book)

    def find_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, count) of hashes; node is -1 and count 0 for unknown ones."""
        known = self.levels["words"].decode()
        at = np.searchsorted(known, words)
        hit = known[np.minimum(at, len(known) - 1)] == words if len(known) else np.zeros(len(words), bool)
        node = np.where(hit, at, -1)
        return node, np.where(hit, np.asarray(self.counts)[np.minimum(node, len(known) - 1)] if len(known) else 0, 0).astype(np.int64)

    def find(self, node: np.ndarray, context: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """Values of (node, context) queries sorted by node; NaN where a node hasn't the context."""
        out = np.full(len(node), np.nan)
        contexts = self.levels["contexts"].decode()
        pointers = self.levels["pointers"].decode().astype(np.int64)
        asked = np.flatnonzero(node >= 0)
        if not len(asked) or not len(contexts):
            return out
        place = np.searchsorted(contexts, context[asked])
        good = contexts[np.minimum(place, len(contexts) - 1)] == context[asked]
        asked, place = asked[good], place[good].astype(np.uint64) + np.uint64(1)
        nodes = node[asked]
        places = self.levels["places"]
        while len(asked):
            # the nodes whose contexts lie in one block, or a single larger node
            start = int(pointers[nodes[0]])
            last = max(int(np.searchsorted(pointers, start + block, "right")) - 1, int(nodes[0]) + 1)
            stop, n = int(pointers[last]), int(np.searchsorted(nodes, last))
            from_ = max(0, start - 1)
            values = places.decode(from_, stop)
            b, e = pointers[nodes[:n]], pointers[nodes[:n] + 1]
            base = np.where(b > 0, values[np.maximum(b - 1 - from_, 0)] if len(values) else 0, 0).astype(np.uint64)
            at = np.searchsorted(values, base + place[:n]) + from_
            hit = (at < e) & (at >= b)
            hit[hit] = values[at[hit] - from_] == (base + place[:n])[hit]
            out[asked[:n][hit]] = self.book[0] + self.book[1] * np.asarray(self.codes[start:stop])[at[hit] - start].astype(float)
            asked, place, nodes = asked[n:], place[n:], nodes[n:]
        return out


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _unique_counts(pair: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, doc) and how often each occurs, by pair and then doc."""
    if int(pair.max(initial=0)) < (1 << 63) // max(docs, 1):
        keys, n = np.unique(pair * np.int64(docs) + doc, return_counts=True)
        return keys // docs, keys % docs, n
    order = np.lexsort((doc, pair))
    pair, doc = pair[order], doc[order]
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])
    return pair[first], doc[first], np.diff(np.r_[first, len(pair)])


class _Batch:
    """Texts that are counted together. Training documents get the lower numbers."""

    def __init__(self):
        self.ids: dict[bytes, int] = {START: 0, END: 1}
        self.docs: list[tuple] = []
        self.tokens = 0

    def add(self, row: int, held: bool, text: str | None) -> None:
        ids = self.ids
        coded = [0, *[ids.setdefault(w, len(ids)) for w in words_of(text)], 1]
        self.docs.append((held, row, np.array(coded, np.int64)))
        self.tokens += len(coded) - 1

    def full(self) -> bool:
        return self.tokens >= BATCH_TOKENS or len(self.docs) >= BATCH_DOCS

    def blocks(self, shards: int) -> Iterator[tuple[int, bytes]]:
        hashes = np.fromiter(map(_hash, self.ids), np.uint64, len(self.ids))
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((hashes, shard))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        hashes, shard = hashes[order], shard[order]
        self.docs.sort(key=lambda d: d[0])
        train = sum(not d[0] for d in self.docs)
        coded = [number[d[2]] for d in self.docs]
        size = len(hashes)
        n_docs = len(coded)
        pair = np.concatenate([c[1:] * size + c[:-1] for c in coded])
        doc = np.repeat(np.arange(n_docs), [len(c) - 1 for c in coded])
        del coded
        self.docs = [(held, row, len(c)) for held, row, c in self.docs]
        pair, doc, n = _unique_counts(pair, doc, n_docs)
        word, context = pair // size, pair % size
        edges = np.searchsorted(shard, np.arange(shards + 1))
        cuts = np.searchsorted(word, edges)
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a == b:
                continue
            used, place = np.unique(context[a:b], return_inverse=True)
            five = (hashes[used] & CONTEXT_MASK).view(np.uint8).reshape(-1, 8)[:, :5].copy()
            words = hashes[edges[s] : edges[s + 1]]
            steps = np.diff(word[a:b] - edges[s], prepend=0)
            yield s, _pack(train, n_docs, words, five, _small(steps), _small(place), _small(doc[a:b]), _small(n[a:b]))


def _counted(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks by batch and shard, and per batch one row of the documents' keys."""
        part = TaskContext.get().partitionId()
        made, batch, keys = 0, _Batch(), []

        def flush() -> pa.RecordBatch:
            nonlocal made, batch, keys
            name = (part << 32) + made
            rows = list(batch.blocks(shards))
            order = [d[1] for d in batch.docs]  # as blocks() has sorted them
            info = _pack([keys[r] for r in order], [bool(d[0]) for d in batch.docs], np.array([d[2] - 1 for d in batch.docs]))
            out = pa.RecordBatch.from_pydict(
                {
                    "batch": pa.array([name] * (len(rows) + 1), pa.int64()),
                    "shard": pa.array([s for s, _ in rows] + [name % shards], pa.int32()),
                    "info": pa.array([False] * len(rows) + [True]),
                    "block": pa.array([b for _, b in rows] + [info], pa.binary()),
                }
            )
            made, batch, keys = made + 1, _Batch(), []
            return out

        for b in batches:
            for key, held, text in zip(*(b.column(k) for k in range(3)), strict=True):
                batch.add(len(keys), held.as_py(), text.as_py())
                keys.append(key.as_py())
                if batch.full():
                    yield flush()
        if keys:
            yield flush()

    return run


COUNTED = "batch long, shard int, info boolean, block binary"
RESULT = "batch long, info boolean, block binary"


def _shard_trie(packed: list[bytes], total: int, unknown: float, strength: float) -> tuple[Trie, list[tuple], np.ndarray, np.ndarray]:
    """The shard's trie from the training documents of all blocks; the blocks' triples, and the words and contexts they number.

    A triple keeps one 64-bit key, word number x contexts + context number, so that a shard's memory is about 20 bytes a
    triple.
    """
    words, contexts = [], []
    for blob in packed:
        own, five = _unpack(blob)[2:4]
        words.append(own)
        contexts.append(_wide(five))
    words = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    contexts = np.unique(np.concatenate(contexts)) if contexts else np.zeros(0, np.uint64)
    size = np.int64(max(1, len(contexts)))
    triples, keys, counts = [], [], []
    for blob in packed:
        train, docs, own, five, steps, place, doc, n = _unpack(blob)
        key = np.searchsorted(words, own)[np.cumsum(steps, dtype=np.int64)] * size + np.searchsorted(contexts, _wide(five))[place]
        triples.append((docs, key, doc, n))
        keys.append(key[doc < train])
        counts.append(n[doc < train])
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    n = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    del keys, counts
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, fresh) if len(fresh) else n
    key = key[fresh]
    used, node = np.unique(key // size, return_inverse=True)
    sums = np.bincount(node, n, len(used)).astype(np.int64)
    value = np.log10(n + strength * (1 - unknown) * sums[node] / max(total, 1)) if len(n) else np.zeros(0)
    return Trie.build(words[used], sums, node, contexts[key % size], value), triples, words, contexts


def _wide(five: np.ndarray) -> np.ndarray:
    """Numbers of five bytes as 64-bit ones."""
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view(np.uint64).reshape(-1)


def _score_blocks(trie: Trie, triples: list[tuple], words: np.ndarray, contexts: np.ndarray, total: int, unknown: float, strength: float) -> Iterator[bytes]:
    node, counts = trie.find_words(words)
    lone = np.log10(strength * np.where(counts > 0, (1 - unknown) * counts / max(total, 1), unknown))
    before, base = np.log10(counts + strength), np.log10(counts + 1.0)
    size = np.int64(max(1, len(contexts)))
    for lot in _lots(triples):
        # one search for the lot: it decodes levels whole, which for every block would grow with the square of the text
        every = np.unique(np.concatenate([key for _, key, _, _ in lot]))
        word = every // size
        # a pair of an unknown context never is in the trie, as the context was not seen in training
        pair = trie.find(node[word], contexts[every % size])
        value = np.where(np.isnan(pair), lone[word], pair) - before[word]
        del pair
        for _, key, doc, n in lot:
            at = np.searchsorted(every, key)
            own = word[at]
            # only the documents that the block has tokens of: blocks get smaller as shards get more
            used, place = np.unique(doc, return_inverse=True)
            sums = [np.bincount(place, n * x, len(used)) for x in (value[at], base[own])]
            yield _pack(_small(used), _small(np.bincount(place, n * (counts[own] > 0), len(used)).astype(np.int64)), *sums)


def _lots(triples: list[tuple]) -> Iterator[list[tuple]]:
    """Blocks in order, in lots of LOT triples or little more."""
    lot, held = [], 0
    for t in triples:
        lot.append(t)
        held += len(t[1])
        if held >= LOT:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def _solve(total: int, unknown: float, strength: float, tries: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        info = group[group["info"]]
        rest = group[~group["info"]].sort_values("batch", kind="stable")
        trie, triples, words, contexts = _shard_trie(rest["block"].tolist(), total, unknown, strength)
        folder = tempfile.mkdtemp()
        path = os.path.join(folder, "trie")
        try:
            trie.write(path)
            if tries:
                with open(path, "rb") as f:
                    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "trie": [f.read()]})
            scores = list(_score_blocks(Trie.open(path), triples, words, contexts, total, unknown, strength))
        finally:
            if os.path.exists(path):
                os.remove(path)
            os.rmdir(folder)
        return pd.DataFrame({"batch": [*rest["batch"], *info["batch"]], "info": [False] * len(rest) + [True] * len(info), "block": [*scores, *info["block"]]})

    return run


def _merge(total: int, kinds: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A batch's sums over all shards, with its documents' keys."""
        keys, held, tokens = _unpack(group[group["info"]]["block"].iloc[0])
        known, score, base = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys))
        for b in group[~group["info"]].sort_values("block")["block"]:
            docs, k, s, c = _unpack(b)
            known[docs] += k.astype(np.int64)
            score[docs] += s
            base[docs] += c
        base -= tokens * np.log10(total + kinds + 1.0)
        return pd.DataFrame({"key": pd.array(keys, "Int64"), "held_out": held, "n_tokens": tokens, "n_known": known, "train_tokens": total, "base_score": base, "score": score})

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, count) of training words, and tokens of all documents under a null hash."""
    from collections import Counter

    counts: Counter = Counter()
    tokens = 0

    def flush() -> pa.RecordBatch:
        nonlocal counts, tokens
        hashes = np.fromiter(map(_hash, counts), np.uint64, len(counts)).view(np.int64)
        out = pa.RecordBatch.from_arrays([pa.array([*hashes.tolist(), None], pa.int64()), pa.array([*counts.values(), tokens], pa.int64())], ["word", "n"])
        counts, tokens = Counter(), 0
        return out

    for b in batches:
        for held, text in zip(b.column(1), b.column(2), strict=True):
            words = words_of(text.as_py())
            tokens += len(words) + 1
            if not held.as_py():
                counts.update(words)
                counts[END] += 1
        if len(counts) > BATCH_TOKENS // 8:
            yield flush()
    if tokens:
        yield flush()


def _prepared(docs: DataFrame, held_out: Column, key: str, text: str) -> tuple[DataFrame, int, int, float, int]:
    """Rows (key, held, text), and N, distinct words, the unknown class's probability and the number of shards."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    by_word = rows.mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    is_word = F.col("word").isNotNull()
    facts = by_word.agg(
        F.sum(F.when(is_word, F.col("n"))), F.count(F.when(is_word, 1)), F.count(F.when(is_word & (F.col("n") == 1), 1)), F.sum(F.when(~is_word, F.col("n")))
    ).first()
    total, kinds, once, tokens = (int(x or 0) for x in facts)
    return rows, total, kinds, (once + 1) / (total + once + 2), max(1, -(-tokens // SHARD_TOKENS))


def tries(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", strength: float = M) -> DataFrame:
    """(shard, trie): the model's files, for ``Trie.open``."""
    rows, total, _, unknown, shards = _prepared(docs, held_out, key, text)
    counted = rows.mapInArrow(_counted(shards), COUNTED)
    return counted.groupBy("shard").applyInPandas(_solve(total, unknown, strength, True), "shard int, trie binary")


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", strength: float = M) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    ``held_out`` is a condition; rows where it is null or false are trained on. Keys are integers.
    """
    rows, total, kinds, unknown, shards = _prepared(docs, held_out, key, text)
    counted = rows.mapInArrow(_counted(shards), COUNTED)
    parts = counted.groupBy("shard").applyInPandas(_solve(total, unknown, strength, False), RESULT)
    merged = parts.groupBy("batch").applyInPandas(_merge(total, kinds), "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return merged.withColumnRenamed("key", key)

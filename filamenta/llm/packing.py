"""Packing token sequences: best fit, then a local search that swaps documents until bins empty.

A document is its token ids and one end id. Only documents longer than a sequence are cut, into full pieces and a rest.
Pieces are dealt by hash to shards of about SHARD pieces, which are packed independently, so that no task grows with the
input. Within a shard pieces go, longest first, to the fullest bin that has room. While a shard has more bins than its
tokens need, the search takes the emptiest bin and, against every other underfull bin, tries to move a piece, to
exchange one for one, two for one or one for two, accepting what raises the sum of squared fills; a bin that has become
empty goes. What lies in bins under REPACK full is dealt again to fewer shards, together, and packed once more.

Texts are whole; a null or empty text is one piece that holds the end id. Repeated rows are packed as often as they
occur. Rows with a null key are packed like others.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.llm.memory import give_back
from filamenta.session import staged

LENGTH, END = 4096, 1
SHARD = 4096
REPACK = 0.97
CACHED_WORDS = 300_000
LOT_BYTES = 1 << 20  # of texts whose words are looked up at once


class Encoder:
    """Token ids by a tokenizers file that lower-cases and drops white space, with the ids of words kept.

    Such a tokenizer works on each run between ASCII white space alone, so ids of the runs, joined, are the ids of the
    text. ASCII marks after an ASCII letter are one token run of their own, so a word's ids serve with and without them.
    Words of letters alone give one token with a word end each; new ones are read together and parted there.
    """

    MARKS = string.punctuation.encode()
    WORD_END = "</w>"
    TOGETHER = 256  # new words in one reading

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.older: dict[bytes, bytes] = {}  # words of the lots before, which go if they are not asked for again
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(self.WORD_END)]] = True

    def _alone(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        letters = [w for w in words if w.isalpha() or not w.isascii() and w.decode().isalpha()]
        known, odd = self.known, list(set(words).difference(letters))
        lots = [letters[i : i + self.TOGETHER] for i in range(0, len(letters), self.TOGETHER)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([b" ".join(lot).decode() for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(stops) != len(lot):  # some letter is another character in lower case
                odd += lot
                continue
            raw, start = ids.tobytes(), 0
            for w, stop in zip(lot, stops.tolist(), strict=True):
                known[w] = raw[start:stop]
                start = stop
        self._alone(odd)

    def _lookup(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) + len(words) > CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older

        def lacking(asked: Iterable[bytes]) -> list[bytes]:
            known.update({w: older[w] for w in asked if w in older and w not in known})
            return [w for w in asked if w not in known]

        new = lacking(words)
        parts, needed = {}, set()
        for w in new:
            stem = w.rstrip(self.MARKS)
            if len(stem) < len(w) and stem and (97 <= stem[-1] <= 122) and b"<|" not in w:
                parts[w] = stem
                needed.add(stem)
                needed.add(w[len(stem) :])
            else:
                needed.add(w)
        self._learn(lacking(needed))
        for w, stem in parts.items():
            known[w] = known[stem] + known[w[len(stem) :]]
        return [known[w] for w in words]

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; where each text's ids end). Names of special tokens are read as they are written."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        raw = self._lookup(coded.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids = np.frombuffer(b"".join(raw), "<u4")
        word = coded.indices.to_numpy(zero_copy_only=False)
        size_at = size[word]
        stop = np.cumsum(size_at)
        flat = ids[np.repeat((np.cumsum(size) - size)[word] - (stop - size_at), size_at) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.r_[0, stop][split.offsets.to_numpy() - split.offsets[0].as_py()][1:]
        return flat, ends


def _lots(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first, texts): runs of about LOT_BYTES, or one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum() if len(texts) else []
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + LOT_BYTES, "right")))
        yield first, texts.slice(first, stop - first)
        first = stop


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """One encoder for each worker; ``name`` is a public tokenizer's file name."""
    if name not in _ENCODERS:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[name] = Encoder(public_tokenizers.path(name))
    return _ENCODERS[name]


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32): one row per piece; with ``ids`` also the piece's ids as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), np.array([END], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for first, texts in _lots(batch.column(1)):
                flat, ends = encode(texts)
                begin = 0
                for i, stop in enumerate(ends.tolist(), first):
                    own = np.concatenate((flat[begin:stop], end))
                    begin = stop
                    for p, at in enumerate(range(0, len(own), length)):
                        part = own[at : at + length].tobytes()
                        rows.append((i, p, at, len(part) // 4, zlib.crc32(part), part if ids else None))
            take, piece, start, n, crc, part = (list(c) for c in zip(*rows, strict=True)) if rows else ([] for _ in range(6))
            columns = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, n, crc))]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(part, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        encode.forget()  # the worker lives on, with other stages' tasks
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' if ids else ''}")
    return out.withColumnRenamed("key", key)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each to the fullest bin with room."""
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    mask, bins = 0, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fit = mask >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = open_at[free].pop()
            if not open_at[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            b, free = len(bins), size
            bins.append([i])
        free -= n
        open_at[free].append(b)
        mask |= 1 << free
    return bins


class _Search:
    """Bins by fill, and what each underfull one offers in a trade: its pieces' lengths, and sums of two of them.

    Pieces of one length are alike, so a bin lists each of its lengths once; a bin of ``size`` has fewer than
    sqrt(2 size) of them, which bounds the sums.
    """

    GONE = 1 << 40

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fills = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.offers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.left = len(bins)

    def offer(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(takes, pairs) of a bin: the lengths that it can give back in a trade (0 for none), and sums of two as (sum, one)."""
        if b not in self.offers:
            own, n = np.unique([self.lengths[i] for i in self.bins[b]], return_counts=True)
            i, j = np.triu_indices(len(own))
            both = (i != j) | (n[i] > 1)
            self.offers[b] = np.r_[0, own], np.c_[own[i] + own[j], own[i]][both]
        return self.offers[b]

    def _take(self, b: int, lengths: list[int]) -> list[int]:
        out = []
        for n in lengths:
            k = next(k for k, i in enumerate(self.bins[b]) if self.lengths[i] == n)
            out.append(self.bins[b].pop(k))
        return out

    def empty(self, low: int) -> bool:
        """Trades that move tokens from ``low`` to fuller bins, the largest first, until none is left or it is empty; True if any was made."""
        others = np.flatnonzero((self.fills >= max(1, self.fills[low])) & (self.fills < self.size))
        others = others[others != low].tolist()
        if not others:
            return False
        offers = [self.offer(b) for b in others]
        one, one_at = np.concatenate([o[0] for o in offers]), np.repeat(others, [len(o[0]) for o in offers])
        two, two_at = np.concatenate([o[1] for o in offers]), np.repeat(others, [len(o[1]) for o in offers])
        changed = False
        while self.bins[low]:
            takes, pairs = self.offer(low)
            gives = np.r_[takes[1:], pairs[:, 0]]  # one or two of the low bin's
            first = np.r_[takes[1:], pairs[:, 1]]
            order = np.argsort(gives, kind="stable")
            gives, first = gives[order], first[order]
            room = self.size - self.fills
            best = (0, 0, [], [])
            for give, start, back, at, parts in ((gives, first, one, one_at, None), (takes[1:], takes[1:], two[:, 0], two_at, two[:, 1])):
                k = np.searchsorted(give, room[at] + back, "right") - 1
                gain = np.where((k >= 0) & (back < self.GONE), give[np.maximum(k, 0)] - back, 0)
                top = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[top] > best[0]:
                    g, f, r = int(give[k[top]]), int(start[k[top]]), int(back[top])
                    returned = [] if not r else [r] if parts is None else [int(parts[top]), r - int(parts[top])]
                    best = (int(gain[top]), int(at[top]), [f] if g == f else [f, g - f], returned)
            gain, high, given, returned = best
            if not gain:
                break
            moved, back_again = self._take(low, given), self._take(high, returned)
            self.bins[low] += back_again
            self.bins[high] += moved
            self.fills[low] -= gain
            self.fills[high] += gain
            self.offers.pop(low, None)
            self.offers.pop(high, None)
            one[one_at == high], two[two_at == high, 0] = self.GONE, self.GONE
            if self.fills[high] < self.size:
                a, b = self.offer(high)
                one, one_at = np.r_[one, a], np.r_[one_at, np.full(len(a), high)]
                two, two_at = np.r_[two, b], np.r_[two_at, np.full(len(b), high)]
            changed = True
        self.left -= not self.bins[low]
        return changed


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Raises the sum of squared fills by trades with the emptiest bins, until none helps or no bin can be spared.

    A trade moves a piece, or exchanges one for one, two for one or one for two, so that tokens go from the emptier bin to
    the fuller one; squared fill rises with every trade. As many of the emptiest bins are worked on as could be spared,
    until none of them has a trade. Then every other underfull bin is worked on once, and if the emptiest ones free a bin
    after that, the search goes on.
    """
    search = _Search(bins, lengths, size)
    least = -(-int(search.fills.sum()) // size)

    def sweep(start: int, stop: int) -> bool:
        changed = False
        for low in np.argsort(np.where(search.fills > 0, search.fills, size + 1), kind="stable")[start:stop].tolist():
            if 0 < search.fills[low] < size and search.left > least:
                changed |= search.empty(low)
        return changed

    before = len(bins) + 1
    while least < search.left < before:
        before = search.left
        for widen in (False, True):
            if widen:
                sweep(search.left - least, search.left)
            while search.left > least and sweep(0, search.left - least):
                pass
    return [b for b in bins if b]


def pack(lengths: list[int], size: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers. Items of a bin's full size stay alone."""
    return local_search(best_fit(lengths, size), lengths, size)


def _pack_shards(rows: DataFrame, size: int, shards: int, turn: int) -> DataFrame:
    """Adds sequence_id, offset and the sequence's fill; rows have (row, length)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].tolist()
        at, offset, fill = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        for b, items in enumerate(pack(lengths, size)):
            place = 0
            for i in items:
                at[i], offset[i] = b, place
                place += lengths[i]
            fill[items] = place
        first = (turn << 56) + (int(group["shard"].iloc[0]) << 28)
        return group.drop(columns="shard").assign(sequence_id=at + first, offset=offset, fill=fill)

    names = [f for f in rows.schema.fields if f.name != "shard"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long, fill long"
    # rows are dealt by their place in the staged table, so that equal rows part and a lost task is dealt the same again
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, schema)


def packed(found: DataFrame, size: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``found`` (a table of pieces that is cheap to read again) with sequence_id and offset. No row is lost or cut."""
    total = found.count()
    first = staged(_pack_shards(found, size, max(1, -(-total // shard)), 0), "packed")
    loose = first.where(F.col("fill") < int(REPACK * size))
    left = loose.count()
    again = _pack_shards(loose.select(*found.columns), size, max(1, -(-left // shard)), 1)
    return first.where(F.col("fill") >= int(REPACK * size)).unionByName(again).drop("fill")


def packed_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    return packed(staged(pieces(docs, tokenizer, length, key, text), "pieces"), length)

"""Toxicity by two class-conditional Kneser-Ney models.

Words are lower-cased runs of letters and digits. Each class has an interpolated Kneser-Ney bigram model: discounted counts
of word pairs, backed off to what both classes share about the pair, backed off to the class's discounted continuation
counts of the word, backed off to what both share about the word, backed off to one part in the vocabulary and one more for
words that the sample lacks. What is shared counts, as continuation counts do, in how many classes an expression occurs, so
that a rare one is judged by what it shares with others. Every level sums to one, so a text has a log-likelihood in each
class; counts are of distinct contexts at every level, so that a passage that many documents repeat counts once. What is
compared is the difference of the two, by words after words and by words alone, divided by the number of words: of the
whole text, and of its strongest stretches of WINDOWS words, as a long text dilutes a short insult.
A logistic curve, fitted on documents that the counts did not see, turns these into a score from 0 to 1.

The counts come from a bounded sample: at most FIT_DOCS labelled documents of each class, those with the smallest hash of
their key, and one row a key. That bounds the model, which one task fits and which is broadcast. Scoring covers every row
and whole texts.

Null and empty texts, and others without words, have no evidence and get the curve's score for none. Labels that are null
are ignored; a document with contradicting labels is toxic. Repeated rows score alike, also in the sample, where the
largest of a repeated key's texts counts. Ties of hashes go to the smaller key. Without both classes in the sample the
score is the smoothed share of toxic labels, and a quarter without any, so that nothing is taken for toxic unseen. An empty table gives an empty result.
Columns of other names pass through untouched; the score replaces a column of its own name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.llm.memory import give_back

FIT_DOCS = 2000
WINDOWS = (1, 4, 32)
FEATURES = 2 * (1 + len(WINDOWS))
LOT_BYTES = 1 << 22  # of texts whose words are coded at once
LOT_WORDS = 1 << 18  # that are scored at once, or one longer text
MIX = np.int64(-7046029254386353131)  # an odd number; products wrap
NO_WORD = r"[^\p{L}\p{N}]+"


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each word's number in them, where each text's words end)."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), NO_WORD)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(full)][split.offsets.to_numpy() - split.offsets[0].as_py()][1:]
    words = flat.filter(pa.array(full)).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends


def lots(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of about LOT_BYTES, or one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + LOT_BYTES, "right")))
        yield texts.slice(first, stop - first)
        first = stop


def hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _level(counts: np.ndarray, below: np.ndarray, rest: float) -> tuple[np.ndarray, float]:
    """Discounted shares of counts, with the mass left over dealt as ``below`` (and ``rest`` for what is not listed) says."""
    total = counts.sum()
    if not total:
        return below, rest
    d = _discount(counts)
    left = d * (counts > 0).sum() / total
    return np.maximum(counts - d, 0) / total + left * below, left * rest


def _counts(pairs: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts n of sorted pairs, 0 for those that are not there."""
    if not len(pairs):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
    return np.where(pairs[at] == asked, n[at], 0)


class Discounted:
    """Discounted shares of pairs v * size + w among their v, and the share of v that is left for the level below."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, size: int):
        self.size, self.pairs, self.n = size, pairs, n
        self.d = _discount(n)
        v = pairs // size
        self.seen = np.bincount(v, n, size + 1)
        self.left = np.where(self.seen > 0, self.d * np.bincount(v, minlength=size + 1) / np.maximum(self.seen, 1), 1.0)

    def of(self, pairs: np.ndarray, below: np.ndarray) -> np.ndarray:
        v = pairs // self.size
        return np.maximum(_counts(self.pairs, self.n, pairs) - self.d, 0) / np.maximum(self.seen[v], 1) + self.left[v] * below


def _parts(word: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(ends, prepend=0)
    return word[np.repeat(keep, n)], np.cumsum(n[keep])


def _pair_counts(word: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs v * size + w of the texts' words, and after how many different words each occurs."""
    first = np.r_[0, ends[:-1]][np.diff(ends, prepend=0) > 0]
    pair = np.empty(len(word), np.int64)
    pair[1:] = word[:-1]
    pair[first] = size
    pair *= size
    pair += word
    triple = np.empty(len(word), np.int64)  # a pair's occurrences after the same pair are one: the mixed number tells them apart
    triple[1:] = pair[:-1]
    triple[first] = -1
    triple *= MIX
    triple ^= triple >> 29
    triple *= MIX
    triple += word
    _, one = np.unique(triple, return_index=True)
    del triple
    pair = pair[one]
    del one
    pair, n = np.unique(pair, return_counts=True)
    return pair, n.astype(np.int32)


class Models:
    """Log-likelihood ratios, toxic against ordinary: of words after words of no known pair, and of known pairs."""

    def __init__(self, word: np.ndarray, ends: np.ndarray, toxic: np.ndarray, names: np.ndarray):
        """word: numbers of all texts' words; names: the sorted hashes of the numbers 0, 1, ..."""
        size = len(names)
        counted = [_pair_counts(*_parts(word, ends, toxic == c), size) for c in (0, 1)]
        follow = [np.bincount(k % size, minlength=size).astype(float) for k, _ in counted]  # continuation counts of words
        # what both classes share counts classes, not occurrences: an expression of one class weighs 1, of both 2
        below = _level(sum((f > 0).astype(float) for f in follow), np.full(size, 1 / (size + 1)), 1 / (size + 1))
        (ordinary, ordinary_other), (mean, mean_other) = (_level(f, *below) for f in follow)
        del follow, below
        both, kinds = np.unique(np.concatenate([k for k, _ in counted]), return_counts=True)
        shared = Discounted(both, kinds.astype(np.int8), size)
        sides = [Discounted(k, n, size) for k, n in counted]
        self.pairs, self.ratio = both, np.empty(len(both), np.float32)
        for at in range(0, len(both), LOT_WORDS):
            part = both[at : at + LOT_WORDS]
            logs = [np.log(side.of(part, shared.of(part, p[part % size]))) for side, p in zip(sides, (ordinary, mean), strict=True)]
            self.ratio[at : at + LOT_WORDS] = logs[1] - logs[0]
        self.names, self.size = names, size
        used = np.zeros(size, bool)
        used[word] = True
        unknown = float(np.log(mean_other) - np.log(ordinary_other))
        self.words = np.r_[np.where(used, np.log(mean) - np.log(ordinary), unknown), unknown].astype(np.float32)
        self.after = np.r_[np.log(sides[1].left) - np.log(sides[0].left), 0.0].astype(np.float32)  # start is number size, an unknown word size + 1

    def __getstate__(self) -> dict:
        """Sorted numbers as their differences and ratios to three digits, as the model travels by the driver."""
        state = dict(self.__dict__)
        for name in ("names", "pairs"):
            state[name] = np.diff(state[name], prepend=state[name].dtype.type(0)).view(np.uint8).reshape(-1, 8).T.copy()
        state["ratio"] = self.ratio.astype(np.float16)
        return state

    def __setstate__(self, state: dict) -> None:
        for name, kind in (("names", np.uint64), ("pairs", np.int64)):
            state[name] = np.cumsum(np.ascontiguousarray(state[name].T).view(kind).reshape(-1), dtype=kind)
        state["ratio"] = state["ratio"].astype(np.float32)
        self.__dict__.update(state)

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """The numbers of hashed words, ``size`` for unknown ones."""
        at = np.minimum(np.searchsorted(self.names, names), self.size - 1)
        return np.where(self.names[at] == names, at, self.size)

    def evidence(self, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Per text, for either order, the mean ratio over its words, and over the strongest stretch of each of WINDOWS; zeros without words."""
        out = np.zeros((len(ends), FEATURES))
        first = 0
        while first < len(ends):
            at = ends[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(ends, at + LOT_WORDS, "right")))
            out[first:stop] = self._evidence(word[at : ends[stop - 1]], ends[first:stop] - at)
            first = stop
        return out

    def _evidence(self, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ends), FEATURES))
        if not len(word):
            return out
        word = word.astype(np.int64)
        begin = np.r_[0, ends[:-1]]
        held = ends > begin
        before = np.where(np.r_[0, word[:-1]] == self.size, self.size + 1, np.r_[0, word[:-1]])
        before[begin[held]] = self.size
        single = self.words[word]
        double = single + self.after[before]
        known = np.flatnonzero((word < self.size) & (before <= self.size))
        distinct, back = np.unique(before[known] * self.size + word[known], return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, distinct), len(self.pairs) - 1)
        hit = (self.pairs[at] == distinct)[back]
        double[known[hit]] = self.ratio[at[back[hit]]]
        out[:, : FEATURES // 2] = _stretches(double, begin, ends)
        out[:, FEATURES // 2 :] = _stretches(single, begin, ends)
        return out


def _stretches(x: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Means of x from begin to end, and the largest sum over runs of each of WINDOWS (or the whole, if shorter), a word."""
    n = ends - begin
    held = n > 0
    total = np.r_[0.0, np.cumsum(x, dtype=np.float64)]
    out = np.zeros((len(ends), 1 + len(WINDOWS)))
    out[:, 0] = (total[ends] - total[begin]) / np.maximum(n, 1)
    stop, start, end = np.arange(1, len(x) + 1), np.repeat(begin, n), np.repeat(ends, n)
    for k, most in enumerate(WINDOWS, 1):
        # runs by their last word; those that would begin before their text count only where the text is shorter
        whole = (stop - start >= most) | (end - start < most) & (stop == end)
        value = np.where(whole, total[stop] - total[np.maximum(stop - most, start)], -np.inf)
        out[held, k] = np.maximum.reduceat(value, begin[held]) / most
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] * (x.shape[1] - 1) + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def hashed_words(texts: pa.Array) -> list[np.ndarray]:
    """Per text the hashes of its words."""
    out: list[np.ndarray] = []
    for lot in lots(texts):
        names, word, ends = coded(lot)
        out += np.split(hashes(names)[word], ends[:-1])
    return out


def fit(docs: list[np.ndarray], toxic: list[int], shares: tuple[float, float]) -> dict:
    """Models and curve from the texts' hashed words. shares: labelled documents for each sampled one, of ordinary and of toxic documents."""
    y = np.array(toxic, np.int64)
    ends = np.cumsum(np.array([len(d) for d in docs], np.int64))
    if min((y == 0).sum(), (y == 1).sum()) < 4 or not ends[-1]:
        n = [(y == c).sum() * shares[c] for c in (0, 1)]
        return {"models": None, "curve": None, "prior": float((n[1] + 0.5) / (sum(n) + 2))}
    words = np.concatenate(docs)
    docs.clear()
    named = np.unique(words)
    word = np.searchsorted(named, words).astype(np.int32)
    del words
    fold = np.zeros(len(y), np.int64)
    for c in (0, 1):
        fold[np.flatnonzero(y == c)[1::2]] = 1
    x = np.zeros((len(y), FEATURES))
    for k in (0, 1):
        part = _parts(word, ends, fold != k)
        if not len(part[0]):
            continue
        half = Models(*part, y[fold != k], named)
        lacking = np.ones(len(named) + 1, bool)
        lacking[part[0]] = False
        own, stops = _parts(word, ends, fold == k)
        x[fold == k] = half.evidence(np.where(lacking[own], half.size, own), stops)
    return {"models": Models(word, ends, y, named), "curve": _logistic(x, y, np.array(shares)[y]), "prior": None}


def pack(model: dict) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(model, protocol=5))


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    """The scores of texts."""
    if model["models"] is None:
        return np.full(len(texts), model["prior"])
    own, out = model["models"], [np.zeros(0)]
    for lot in lots(texts):
        names, word, ends = coded(lot)
        x = own.evidence(own.numbers(hashes(names))[word] if names else word, ends)
        out.append(1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ model["curve"], -500, 500))))
    return np.concatenate(out)


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS) -> bytes:
    """Fits on at most ``fit_docs`` documents of each class; one task does so, and the bounded model comes to the driver, packed."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    hashed = known.withColumn("h", F.xxhash64(F.col(key).cast("string")))
    sample = None
    for c in (0, 1):
        part = hashed.where(F.col("y") == c).orderBy("h", key).limit(fit_docs).select(F.col(key).alias("key"), "h", "y")
        sample = part if sample is None else sample.unionByName(part)
    taken = {c: max(1, min(fit_docs, counts.get(c, 0))) for c in (0, 1)}
    shares = tuple(counts.get(c, 0) / taken[c] for c in (0, 1))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    rows = rows.groupBy("h", "key", "y").agg(F.max("text").alias("text")).select("h", "key", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        docs, keys, toxic = [], [], []
        for batch in batches:
            docs += hashed_words(batch.column(2))
            keys += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            toxic += batch.column(3).to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        docs = [docs[i] for i in order]
        model = fit(docs, [toxic[i] for i in order], shares)
        packed = pack(model)
        del model, docs
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else pack(fit([], [], (0.0, 0.0)))


_MODELS: dict[int, dict] = {}


def unpacked(model: bytes) -> dict:
    """The model; each worker process keeps the one that it used last."""
    name = hash(model)
    if name not in _MODELS:
        _MODELS.clear()
        import zstandard

        _MODELS[name] = pickle.loads(zstandard.ZstdDecompressor().decompress(model))
    return _MODELS[name]


def scored(docs: DataFrame, model: bytes, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name``; it replaces a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = unpacked(shared.value)
        for t in texts:
            yield pa.array(scores(own, t), pa.float64())
        del own
        _MODELS.clear()  # the worker lives on, with other stages' tasks
        give_back()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}  # as types, not as their names
    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text)))


def without_toxic(docs: DataFrame, model: bytes, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with their own columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, text, name).where(F.col(name) < least).select(*docs.columns)

"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its shingles of WIDTH words; sets link at a Jaccard similarity of PERCENT or more. All sets have
one order of tokens, rarest first. Of n tokens a partner holds at least o = PERCENT of them, so that two linked sets share a
token in their first n - o + 1; with prefixes longer by l - 1 they share l tokens there. Each document takes the l whose
estimated cost is least: postings of its prefix, plus candidates, of which there are at most postings / l, times the cost of
verifying one. A pair is verified once it shares as many prefix tokens as the shorter of its two prefixes asks for.

How it is dealt. ``_scattered`` sends the tokens of a chunk of documents to buckets by hash, in packed blobs; a bucket counts
its tokens and sends back those that two documents or more hold, with their frequency class. Tokens of a large share of all
documents (HEAVY) are counted before, stay where they are and come last in the order. A token that one document holds can
match nothing: it only fills its document's prefix, and a document whose prefix is full of such tokens is done. Equal sets
are one record from here on. The records that share a prefix token, or are joined by a chain of them, are a world; links do
not leave it. Worlds are solved by tasks; one of more than a part's size is divided: parts, then one member of each cluster,
then what is apart from the largest cluster with every part, so that all pairs that no link has connected yet are compared.
In a task a posting list whose owners are connected with the document is not read again, so that thousands of near copies
cost little more than one.

Documents are read twice, and again where a task is repeated: they come from files or a written table, in one order. Tokens
are 56-bit hashes: two different shingles of a pair of documents of 1,000 words agree by chance once in 10^10 pairs.
Null, empty and white-space texts have no token and link with nothing. Texts are whole, however long. Every row is a document
of its own, also where keys repeat; a null key is never the smallest. Ties do not arise. An empty table gives an empty
result. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filamenta.llm import simhash
from filamenta.llm.memory import give_back
from filamenta.operators.graph import connected_components
from filamenta.operators.joins import hot_join
from filamenta.session import staged

WIDTH, PERCENT = 4, 85
#: Tokens and documents of a chunk; tokens of a bucket.
CHUNK, CHUNK_DOCS, BUCKET = 1 << 19, 1 << 16, 1 << 21
#: A token is heavy if over 1 / HEAVY of the documents hold it; there are at most HEAVY times the mean set size of them.
HEAVY, SEEN = 64, 64
#: Class of heavy tokens, which are last in the order. Cost of a token in verification against a posting in the search.
LAST, VERIFY = 63, 0.25
FEW = 8


def tokens_of(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 56-bit numbers."""
    words = simhash.words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(simhash.rolled(simhash.word_hashes(words), width) >> np.uint64(8))


def least_shared(n, percent: int):
    """Tokens that a set of n shares at least with any that it links with."""
    return -(-percent * n // 100)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpacked(b) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view("<u8").ravel()


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    keys, sets, size = [], [], 0
    for batch in batches:
        for k, t in zip(*batch.columns, strict=True):
            keys.append(k.as_py())
            sets.append(tokens_of(t.as_py(), width))
            size += len(sets[-1])
            if size >= CHUNK or len(keys) >= CHUNK_DOCS:
                yield keys, sets
                keys, sets, size = [], [], 0
    if keys:
        yield keys, sets


def digest(tokens: np.ndarray) -> bytes | None:
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _sizes(width: int):
    """(key, n, same) of every document; and rows (token, held) for tokens that many documents of a chunk hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for keys, sets in _chunks(seen(batches), width):
            token, held = np.unique(np.concatenate(sets), return_counts=True)
            many = held >= max(SEEN, len(keys) // (4 * HEAVY))
            m = int(many.sum())
            none = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(keys, kind), none(kind, m)]),
                    pa.array([len(s) for s in sets] + [None] * m, pa.int64()),
                    pa.array([digest(s) for s in sets] + [None] * m, pa.binary()),
                    pa.concat_arrays([none(pa.int64(), len(keys)), pa.array(token[many].astype(np.int64))]),
                    pa.concat_arrays([none(pa.int64(), len(keys)), pa.array(held[many])]),
                ],
                ["key", "n", "same", "token", "held"],
            )
        give_back()

    return run


_PACKET = "bucket long, chunk long, docs binary, tokens binary, classes binary, sizes array<long>, same array<binary>"


def _packet(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["bucket", "chunk", "docs", "tokens", "classes", "sizes", "same"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _scattered(width: int, buckets: int, heavy: np.ndarray):
    """A packet for each bucket that a chunk's tokens go to; and one with its sizes, digests and heavy tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for _, sets in _chunks(batches, width):
            sizes = np.array([len(s) for s in sets])
            doc, token = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes), np.concatenate(sets)
            often = np.isin(token, heavy) if len(heavy) else np.zeros(len(token), bool)
            rows = [(chunk % buckets, chunk, doc[often].tobytes(), packed(token[often]), None, sizes.tolist(), [digest(s) for s in sets])]
            doc, token = doc[~often], token[~often]
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets)) if buckets < 1 << 20 else None
            if ends is None:
                names, first = np.unique(bucket[order], return_index=True)
                cuts = zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True)
            else:
                cuts = ((b, int(ends[b - 1]) if b else 0, int(ends[b])) for b in range(buckets))
            for b, lo, hi in cuts:
                if hi > lo:
                    at = order[lo:hi]
                    rows.append((b, chunk, doc[at].tobytes(), packed(token[at]), None, None, None))
            yield _packet(rows)
            chunk += 1
        give_back()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, its tokens that two documents or more hold go back to their chunks, with classes of their frequency."""

    def solve(held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token, doc = (np.concatenate([h[k] for h in held]) for k in (2, 1))
        _, code, count = np.unique(token, return_inverse=True, return_counts=True)
        df = count[code]
        ends = np.cumsum([len(h[1]) for h in held])
        rows = []
        for (chunk, *_), lo, hi in zip(held, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            shared = np.flatnonzero(df[lo:hi] > 1) + lo
            if len(shared):
                level = np.log2(df[shared]).astype(np.uint8)
                rows.append((0, chunk, doc[shared].tobytes(), packed(token[shared]), level.tobytes(), None, None))
        if rows:
            yield _packet(rows)

    held: list = []
    now = None
    for batch in batches:
        heads = []
        for bucket, chunk, docs, tokens, _, sizes, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sizes is not None:
                heads.append((0, chunk, docs, tokens, None, sizes, same))
                continue
            if bucket != now:
                yield from solve(held)
                now, held = bucket, []
            held.append((chunk, np.frombuffer(docs, np.uint16), unpacked(tokens)))
        if heads:
            yield _packet(heads)
    yield from solve(held)
    give_back()


def matches_asked(level: np.ndarray, base: int, n: int) -> int:
    """How many shared prefix tokens a set asks for: the least estimated cost. ``level``: classes of its shared tokens in order."""
    scan = np.cumsum(np.exp2(np.minimum(level, 40)))[base - 1 :]
    asked = np.arange(1, len(scan) + 1)
    return int(asked[np.argmin(scan + scan / asked * (VERIFY * n))])


_RECORD = "same binary, n int, own int, asked int, head array<long>, tokens binary"


def _records(percent: int):
    """A record of each document that has a shared token in its prefix: its shared tokens, rarest first."""

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        sizes = same = None
        doc, token, level = [], [], []
        for docs, tokens, classes, n, names in parts:
            d, t = np.frombuffer(docs, np.uint16), unpacked(tokens)
            if n is not None:
                sizes, same = np.array(n), names
            doc.append(d)
            token.append(t)
            level.append(np.full(len(d), LAST, np.uint8) if n is not None else np.frombuffer(classes, np.uint8))
        doc, token, level = np.concatenate(doc), np.concatenate(token), np.concatenate(level)
        order = np.lexsort((token, level, doc))
        doc, token, level = doc[order], token[order], level[order]
        shared = np.bincount(doc, minlength=len(sizes))
        own = sizes - shared
        base = sizes - least_shared(sizes, percent) + 1 - own
        ends = np.cumsum(shared)
        rows, first = [], set()
        for k in np.flatnonzero((base > 0) & (shared > 0)).tolist():
            if same[k] not in first:  # equal sets of a chunk give one record
                first.add(same[k])
                lo, hi, b = int(ends[k] - shared[k]), int(ends[k]), int(min(base[k], shared[k]))
                rows.append((same[k], int(sizes[k]), int(own[k]), matches_asked(level[lo:hi], b, int(sizes[k])), token[lo : lo + b].astype(np.int64), packed(token[lo:hi])))
        types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["same", "n", "own", "asked", "head", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for chunk, *part in zip(*(batch.column(c).to_pylist() for c in ("chunk", "docs", "tokens", "classes", "sizes", "same")), strict=True):
                if chunk != now:
                    if parts:
                        yield solve(parts)
                    now, parts = chunk, []
                parts.append(part)
        if parts:
            yield solve(parts)
        give_back()

    return run


def records(docs: DataFrame, light: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, same, n, own, asked, head, tokens): one row for each distinct set that may have a partner."""
    sums = light.agg(F.sum("n"), F.count("n")).first()
    total, count = sums[0] or 0, sums[1]
    frequent = light.where("token is not null").groupBy("token").agg(F.sum("held").alias("held")).where(F.col("held") * HEAVY > count)
    heavy = np.sort(np.array([r[0] for r in frequent.select("token").collect()], np.int64).view(np.uint64))  # fewer than HEAVY times a mean set
    buckets = max(8, -(-total // BUCKET))
    rows = docs.select("key", "text").mapInArrow(_scattered(width, buckets, heavy), _PACKET)
    counted = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, _PACKET)
    found = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_records(percent), _RECORD)
    first = found.groupBy("same").agg(*[F.first(c).alias(c) for c in ("n", "own", "asked", "head", "tokens")])
    return staged(first.withColumn("id", F.monotonically_increasing_id()), "join-records")


def multi_match(n: np.ndarray, own: np.ndarray, asked: np.ndarray, tokens: list[np.ndarray], known: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of records that link, enough to connect all that such pairs connect. ``known``: numbers of what is connected before."""
    order = np.argsort(n, kind="stable")
    n, own, asked = n[order], own[order], asked[order]
    tokens = [tokens[k] for k in order]
    length = np.maximum(0, n - least_shared(n, percent) + asked - own)
    prefix = [t[:k] for t, k in zip(tokens, length.tolist(), strict=True)]
    sizes = np.array([len(p) for p in prefix])
    _, code = np.unique(np.concatenate(prefix), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), sizes)
    by_token = np.argsort(code, kind="stable")  # owners of a token are in order of n
    owners, ends = owner[by_token], np.cumsum(np.bincount(code))
    starts = np.r_[0, ends[:-1]]
    code_of = np.split(code, np.cumsum(sizes)[:-1])
    place = np.empty(len(code), np.int64)
    place[by_token] = np.arange(len(code))
    place_of = np.split(place, np.cumsum(sizes)[:-1])  # where a record stands in its tokens' lists
    whole = [np.sort(t) for t in tokens]
    _, first, root = np.unique(known[order], return_index=True, return_inverse=True)
    root = first[root]
    head, mixed = np.full(len(ends), -1), np.zeros(len(ends), bool)
    found: list[tuple[int, int]] = []

    def link(x: int, y: int) -> bool:
        both = len(np.intersect1d(whole[x], whole[y], assume_unique=True))
        if 100 * both < percent * (int(n[x] + n[y]) - both):
            return False
        a, b = root[x], root[y]
        if a != b:
            root[root == max(a, b)] = min(a, b)
            found.append((int(order[x]), int(order[y])))
        return True

    for x in range(len(n)):
        mine = code_of[x]
        heads = np.unique(head[mine])
        heads = heads[heads >= 0]
        for y in heads[:FEW].tolist():  # mostly one of them links, and then the lists of its cluster need no reading
            if root[x] != root[y]:
                link(x, y)
        apart = mixed[mine] | ((head[mine] >= 0) & (root[head[mine]] != root[x]))
        if apart.any():
            lists = [owners[a:b] for a, b in zip(starts[mine[apart]].tolist(), place_of[x][apart].tolist(), strict=True)]
            met, shared = np.unique(np.concatenate(lists), return_counts=True)
            fit = (shared >= np.minimum(asked[met], asked[x])) & (100 * n[met] >= percent * n[x])
            met = met[fit]
            while len(met := met[root[met] != root[x]]):
                link(x, int(met[0]))
                met = met[1:]
        fresh = head[mine] < 0
        head[mine[fresh]] = x
        mixed[mine] |= root[head[mine]] != root[x]
    return found


class _Worlds(simhash._Verifier):
    """Links within worlds of records."""

    def __init__(self, rows: DataFrame, percent: int):
        self.rows, self.kind, self.percent = rows.select(F.col("id").alias("key"), "n", "own", "asked", "tokens"), "long", percent

    def solved(self, groups: DataFrame, name: str) -> DataFrame:
        percent = self.percent

        def solve(ids: list[int], clusters: list[int], n: list[int], own: list[int], asked: list[int], tokens: list[bytes]) -> pa.RecordBatch:
            pairs = multi_match(*(np.array(v, np.int64) for v in (n, own, asked)), [unpacked(t) for t in tokens], np.array(clusters), percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group != now:
                        if held:
                            yield solve(*zip(*held, strict=True))
                        now, held = group, []
                    held.append(row)
            if held:
                yield solve(*zip(*held, strict=True))
            give_back()

        rows = self.rows.join(groups.select(F.col("doc").alias("key"), "group", "cluster"), "key").select("group", "key", "cluster", "n", "own", "asked", "tokens")
        ready = rows.repartition("group").sortWithinPartitions("group")
        return staged(ready.mapInArrow(run, "a long, b long"), name)


def _worlds(rows: DataFrame) -> DataFrame:
    """(doc, component, size): records that share a prefix token with another, or are joined by a chain of such."""
    heads = staged(rows.select("id", F.explode("head").alias("token")), "join-heads")
    least = heads.groupBy("token").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = hot_join(heads, least, "token", "n", heads.count()).select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = connected_components(edges, "a", "b").withColumnRenamed("node", "doc")
    return staged(rows.select(F.col("id").alias("doc"), (F.length("tokens") / 4 + 200).alias("size")).join(found, "doc"), "join-worlds")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id): one row per row of ``docs``; component_id is the smallest key that links reach, its own included."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    light = staged(rows.mapInArrow(_sizes(width), f"key {kind}, n long, same binary, token long, held long"), "join-sizes")
    each = light.where("n is not null").select("key", "n", "same")
    classes = staged(each.where("same is not null").groupBy("same").agg(F.min("key").alias("least"), F.count("*").alias("rows")), "join-classes")
    found = records(rows, light, width, percent)
    links = _Worlds(found, percent).links(_worlds(found))
    joined = connected_components(links, "a", "b")
    named = found.select("id", "same").join(joined, F.col("id") == F.col("node")).select("same", "component").join(classes.select("same", "least"), "same")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    labels = named.join(smallest, "component").select("same", "smallest")
    known = classes.join(labels, "same", "left").select("same", "rows", F.coalesce("smallest", "least").alias("component_id"))
    full = hot_join(each.where("same is not null"), known, "same", "rows", each.count()).select("key", "n", "component_id")
    out = full.unionByName(each.where("same is null").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")

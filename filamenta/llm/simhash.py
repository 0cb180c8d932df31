"""SimHash near-duplicates: fingerprints over word shingles, linked by a binary trie self-join.

Fingerprint: XXH64 (seed 42) of every shingle of WIDTH words, repeats included; a bit is 1 if it is set in over half of
them. A text of fewer words is one shingle; a text without words (null, empty, white space) has fingerprint 0, which
links like any other.

Links at a budget of BITS or fewer differing bits. Equal fingerprints are one class first, so that copies never meet in
pairs. Two fingerprints within b bits agree on one of b + 1 blocks of bits, so each class goes to b + 1 groups, one for
each block's value. A group of over LIMIT classes is divided again by blocks of its remaining bits, up to MOST_WAYS ways
of dividing and down to LEAST_BITS bits; no group is cut short. Inside the groups two trie nodes descend together, bit by
bit: the pair carries the number of bits that differ so far and is dropped when that exceeds the budget; at most PAIRS
node pairs are advanced at once. Of the links a task finds it passes on a spanning forest, which keeps every connection
and is never larger than its rows.

``one_of_each`` casts a wider net: fingerprints within NET_BITS, and texts that agree on a band of minima of the hashes of
their shingles of ALIKE_WIDTH words, which is what finds nearly all pairs of similarity ALIKE. It compares the texts that
these join exactly, and keeps one document of every component of the links of ALIKE or more.

Nulls, empty and white-space texts are alike; texts are whole, however long. Ties do not arise, as the smallest key stays.
Repeated rows are one document. An empty table gives an empty result. Columns of any other name, also of those used here,
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.llm.memory import give_back
from filamenta.operators.graph import connected_components, forest
from filamenta.operators.joins import hot_join
from filamenta.session import staged

WIDTH, BITS, SEED = 3, 2, 42
LIMIT, LEAST_BITS, MOST_WAYS = 512, 11, 243
PAIRS = 1 << 19
NET_BITS, ALIKE, ALIKE_WIDTH = 6, 0.8, 5
CHUNK = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a part of a component of candidates, with ROW for each text; texts compared one by one before all at once.
LOT, ROW, FEW = 4_000_000, 2000, 8
#: Times that every class is divided by blocks of bits before groups are counted, for budgets over 3 bits: rows and work
#: then grow with the input, and not faster where groups reach LIMIT.
WIDE_DEPTH = 2
#: Minima of shingle hashes: two texts of similarity j agree on a band with chance j ** BAND, on one of BANDS with 0.997 at 0.8.
BANDS, BAND = 25, 7


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(words: list[bytes], width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a sequence of words."""
    from xxhash import xxh64_intdigest as h

    if not words:
        return 0
    if len(words) <= width:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    return majority(np.array([h(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], np.uint64) for i in range(0, len(starts), CHUNK))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The number whose bits are those that are set in over half of the hashes, which come in parts."""
    n, total = 0, np.zeros(64, np.int64)
    for part in parts:
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n += len(part)
        for j in range(0, len(bits), 255):
            total += bits[j : j + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per document; fp holds the 64 bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(words_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of all pairs inside a group whose values differ in at most ``budget`` bits, in parts.

    Rows are sorted by (group, fp) and distinct in it. A trie node is a range of rows that share a prefix; node pairs at
    one depth are advanced together, and split into two lots where there are too many.
    """
    if not len(fp):
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    last = np.r_[first[1:], len(fp)]
    many = last - first > 1
    zeros: dict[int, np.ndarray] = {}
    stack = [(63, first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if not len(al) or bit < 0:
            continue
        if len(al) > pairs:
            half = len(al) // 2
            stack += [(bit, *(x[part] for x in (al, ah, bl, bh, err))) for part in (slice(None, half), slice(half, None))]
            continue
        if bit not in zeros:
            zeros[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1) == 0)]
        z = zeros[bit]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        same = al == bl
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), (am, ah, bl, bm, np.where(same, np.int8(budget + 1), err + 1))]
        al, ah, bl, bh, err = (np.concatenate([p[k] for p in parts]) for k in range(5))
        keep = (err <= budget) & (ah > al) & (bh > bl) & ~((al == bl) & (ah - al == 1))
        leaf = keep & (ah - al == 1) & (bh - bl == 1)
        if leaf.any():  # two single rows: what is left of their bits is compared at once
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            yield i[near], j[near]
            keep &= ~leaf
        stack.append((bit - 1, al[keep], ah[keep], bl[keep], bh[keep], err[keep]))


def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """All of ``trie_links`` at once."""
    found = [(np.zeros(0, np.int64),) * 2, *trie_links(group, fp, budget, pairs)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _links(budget: int):
    def solve(key: np.ndarray, fp: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, doc = key[order], fp[order], doc[order]
        root = np.arange(len(fp))
        for i, j in trie_links(key, fp, budget):
            root = forest(len(fp), i, j, root)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(doc[root[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last group of a batch waits for the next batch."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            held = [c[cut:] for c in now]
            if cut:
                yield solve(*(c[:cut] for c in now))
        if held is not None:
            yield solve(*held)

    return run


def _bits(low: int, n: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))


def _divide(rows: DataFrame, depth: int, blocks: int) -> DataFrame:
    """Each row goes to a group for each of the blocks of the bits that ``way`` leaves free, by the block's value."""
    parts = []
    for name in _ways(depth, blocks):
        bits = _free_after(name, blocks)
        for number in range(blocks):
            value = _gather(bits[slice(*_cut(len(bits), number, blocks))])
            parts.append(F.when(F.col("way") == name, F.struct(F.lit(f"{name}{number}").alias("way"), F.xxhash64("key", F.lit(number), value).alias("key"))))
    return rows.withColumn("to", F.explode(F.array_compact(F.array(*parts)))).select("to.way", "to.key", "fp", "doc")


def _gather(bits: list[int]) -> Column:
    """The named bits of fp, run by run, as an array of numbers."""
    runs: list[list[int]] = []
    for b in bits:
        if runs and runs[-1][-1] == b - 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    return F.array(*[_bits(r[0], len(r)) for r in runs])


def _cut(bits: int, number: int, blocks: int) -> tuple[int, int]:
    return bits * number // blocks, bits * (number + 1) // blocks


def _free_after(way: str, blocks: int) -> list[int]:
    """The bits that the blocks chosen along ``way`` leave free."""
    bits = list(range(64))
    for c in way:
        a, b = _cut(len(bits), int(c), blocks)
        bits = bits[:a] + bits[b:]
    return bits


def _ways(depth: int, blocks: int) -> list[str]:
    return [""] if depth == 0 else [w + str(c) for w in _ways(depth - 1, blocks) for c in range(blocks)]


def near_links(classes: DataFrame, budget: int = BITS) -> DataFrame:
    """Links (a, b) between the ``doc`` of classes (doc, fp); distinct fp, budget of at most 9 bits."""
    if not 0 <= budget <= 9:
        raise ValueError("a budget is 0 to 9 bits")
    blocks = budget + 1
    rows = classes.select(F.lit("").alias("way"), F.lit(0).cast("long").alias("key"), "fp", "doc")
    parts: list[DataFrame] = []
    depth = 0
    while True:
        rows = _divide(rows, depth, blocks)
        depth += 1
        if budget > 3 and depth < WIDE_DEPTH:
            continue
        if blocks ** (depth + 1) > MOST_WAYS or len(_free_after("0" * depth, blocks)) <= LEAST_BITS:
            parts.append(rows)
            break
        rows = staged(rows, "simhash-groups")
        hot = staged(rows.groupBy("key").count().where(F.col("count") > LIMIT).select("key"), "simhash-hot")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti").select("way", "key", "fp", "doc"))
        rows = rows.join(hot, "key", "left_semi").select("way", "key", "fp", "doc")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ready = every.select("key", "fp", "doc").repartition("key").sortWithinPartitions("key")
    kind = classes.schema["doc"].dataType.simpleString()
    return ready.mapInArrow(_links(budget), f"a {kind}, b {kind}")


def near_duplicate_components(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BITS) -> DataFrame:
    """(key, fp, component_id): one row per row of ``docs``; component_id is the smallest key it reaches, itself included.

    Rows whose key is null are kept with a null component; a repeated key is one document. An empty table gives no rows.
    """
    fps = staged(fingerprints(docs, key, text), "simhash-fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min(key).alias("doc"), F.count("*").alias("n")), "simhash-classes")
    found = connected_components(near_links(classes.where("doc is not null"), budget), "a", "b")
    named = classes.join(found, classes["doc"] == found["node"], "left").select("fp", "n", F.coalesce("component", "doc").alias("component_id"))
    out = hot_join(fps, named, "fp", "n", fps.count())
    return out.select(key, "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words, repeats included, from the words' hashes; fewer words, or none, are one shingle."""
    width = min(width, len(hashes))
    out = np.zeros(max(1, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + len(out)]) * MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_hashes(words: list[bytes], width: int = ALIKE_WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of ``width`` words."""
    return np.unique(rolled(word_hashes(words), width))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    return np.fromiter(map(h, words), np.uint64, len(words))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """BANDS values of a set of hashes, each made of BAND minima over multiplied hashes."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND), np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[i : i + 512, None] * odd[0]).min(axis=0))
    return (low * odd[1]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64)


def alike_pairs(sets: list[np.ndarray], least: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets with a Jaccard similarity of ``least`` or more, enough of them to connect all that such pairs connect.

    Two sets that alike share one of their rarest 1 - least parts, so only sets that meet there are compared, and only while
    they are not connected yet. ``known`` are numbers of what is connected before.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    _, token, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    sizes = sizes[order]
    cuts = np.r_[0, np.cumsum(sizes)]
    rows = [np.sort(rank[token[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    heads = [r[: len(r) - int(np.ceil(least * len(r) - 1e-9)) + 1] for r in rows]

    def index(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, owners = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        return np.r_[0, np.cumsum(np.bincount(names, minlength=len(count)))], owners[np.argsort(names, kind="stable")]

    def owners_of(tokens: np.ndarray, at: np.ndarray, owners: np.ndarray) -> np.ndarray:
        return np.concatenate([owners[at[t] : at[t + 1]] for t in tokens.tolist()])

    by_head, by_any, root, found = index(heads), None, np.arange(len(rows)), []
    if known is not None:
        _, first, own = np.unique(known[order], return_index=True, return_inverse=True)
        root = first[own]

    def link(x: int, y: int) -> None:
        a, b = root[x], root[y]
        root[root == max(a, b)] = min(a, b)
        found.append((int(order[x]), int(order[y])))

    for x in range(1, len(rows)):
        met = owners_of(heads[x], *by_head)
        met = np.unique(met[met < x])
        met = met[sizes[met] >= least * sizes[x] - 1e-9]
        tries = 0
        while len(met := met[root[met] != root[x]]):
            if tries < FEW or len(met) <= FEW:
                y, met, tries = int(met[0]), met[1:], tries + 1
                both = len(np.intersect1d(rows[x], rows[y], assume_unique=True))
                if both >= least * (sizes[x] + sizes[y] - both):
                    link(x, y)
                continue
            by_any = by_any or index(rows)
            shared = np.bincount(owners_of(rows[x], *by_any), minlength=len(rows))[met]
            for y in met[shared >= least * (sizes[x] + sizes[met] - shared)].tolist():
                if root[x] != root[y]:
                    link(x, y)
            break
    return found


def _verified(least: float, width: int):
    def solve(keys: list, clusters: list, texts: list) -> list[tuple]:
        found, first = [], {}
        for k, c, t in zip(keys, clusters, texts, strict=True):
            own = first.setdefault(b" ".join(words_of(t)), (k, c))[0]
            if own != k:
                found.append((k, own))
        names = [k for k, _ in first.values()]
        known = np.array([c for _, c in first.values()])
        pairs = alike_pairs([shingle_hashes(t.split(b" ") if t else [], width) for t in first], least, known) if len(names) > 1 else []
        return found + [(names[i], names[j]) for i, j in pairs if names[i] != names[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (group, key, cluster, text) come sorted by group."""
        group, keys, clusters, texts, kind = None, [], [], [], None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            found, kind = [], batch.schema.field(1).type
            for g, k, c, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    found += solve(keys, clusters, texts)
                    group, keys, clusters, texts = g, [], [], []
                keys.append(k)
                clusters.append(c)
                texts.append(t)
            yield out(found)
        if keys:
            yield out(solve(keys, clusters, texts))
        keys, clusters, texts = [], [], []
        give_back()

    return run


def _sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, same, chars, fp, bands): one row per document with a key; ``same`` is one for texts of the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, chars, fps, bands = [], [], [], []
            for t in batch.column(1):  # one text's words at a time
                words = words_of(t.as_py())
                joined = b" ".join(words)
                same.append(blake2b(joined, digest_size=16).digest())
                chars.append(len(joined))
                hashes = word_hashes(words)
                fps.append(majority([rolled(hashes, WIDTH)]) if words else 0)
                bands.append(bands_of(np.unique(rolled(hashes, width))).view(np.int64))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(chars, pa.int64()), fps, pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "same", "chars", "fp", "bands"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"doc {kind}, same binary, chars long, fp long, bands array<long>")


def _candidates(classes: DataFrame, budget: int) -> DataFrame:
    """(a, b): links of classes (doc, fp, bands) by fingerprints and by bands; of those on a band each is linked to the first."""
    equal = staged(classes.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("n")), "simhash-classes")
    links = near_links(equal.select("fp", F.col("first").alias("doc")), budget)
    rows = classes.select("doc", F.posexplode("bands").alias("band", "value"))
    shared = staged(rows.groupBy("band", "value").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "simhash-bands")
    total = classes.count()
    on_band = hot_join(rows, shared, ["band", "value"], "n", total)
    alike = hot_join(classes.select("doc", "fp"), equal, "fp", "n", total).select("doc", "first").unionByName(on_band.select("doc", "first")).where("doc <> first")
    return links.unionByName(alike.select(F.col("doc").alias("a"), F.col("first").alias("b")))


class _Verifier:
    """Exact links within components of candidates, every one of which is dealt to parts of about LOT characters.

    The members of a part meet first. Then the clusters of verified links meet by one member each. What is still apart from
    a component's largest cluster is dealt to lots of its own, and every lot meets every part: all pairs that no link has
    connected yet are compared, and a component that is one group of copies costs no more than its texts.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, least: float, width: int):
        self.texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.kind = docs.schema[key].dataType.simpleString()
        self.least, self.width = least, width

    def solved(self, groups: DataFrame, name: str) -> DataFrame:
        """Links (a, b) between the members (doc, cluster) of every ``group``."""
        rows = self.texts.join(groups.select(F.col("doc").alias("key"), "group", "cluster"), "key").select("group", "key", "cluster", "text")
        ready = rows.repartition("group").sortWithinPartitions("group")
        return staged(ready.mapInArrow(_verified(self.least, self.width), f"a {self.kind}, b {self.kind}"), name)

    @staticmethod
    def dealt(members: DataFrame, name: str, total: int) -> DataFrame:
        """``members`` (doc, component, size) with the number of parts of their component, ``name``_of, and their own, ``name``."""
        lots = members.groupBy("component").agg(F.ceil(F.sum("size") / LOT).cast("int").alias(f"{name}_of"), F.count("*").alias("n"))
        placed = hot_join(members, lots, "component", "n", total).drop("n")
        return placed.withColumn(name, F.pmod(F.xxhash64("doc"), F.col(f"{name}_of")).cast("int"))

    @staticmethod
    def clustered(members: DataFrame, links: DataFrame) -> DataFrame:
        found = connected_components(links, "a", "b").select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
        return staged(members.join(found, "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc")), "simhash-clusters")

    def links(self, members: DataFrame) -> DataFrame:
        total = members.count()
        placed = staged(self.dealt(members, "part", total), "simhash-parts")
        found = self.solved(placed.select("doc", F.xxhash64("component", "part").alias("group"), F.col("doc").alias("cluster")), "simhash-alike")
        divided = placed.where("part_of > 1")
        if divided.isEmpty():
            return found
        inside = self.clustered(divided, found)
        heads = self.dealt(inside.where("doc = cluster").select("doc", "component", "size"), "lot", total)
        met = self.solved(heads.select("doc", F.xxhash64("component", "lot").alias("group"), F.col("doc").alias("cluster")), "simhash-heads")
        found = found.unionByName(met)
        inside = self.clustered(divided, found)
        sizes = inside.groupBy("component", "cluster").count()
        largest = sizes.groupBy("component").agg(F.max(F.struct("count", "cluster"))["cluster"].alias("largest"), F.sum("count").alias("n"))
        apart = hot_join(inside, largest, "component", "n", total).where("cluster <> largest").select("doc", "component", "size", "cluster", "part_of")
        lots = staged(self.dealt(apart, "lot", total), "simhash-apart")
        every = lots.groupBy("component").agg(F.max("lot_of").alias("lot_of"))
        to_lots = inside.join(every, "component").select("doc", "cluster", "component", "part", F.explode(F.sequence(F.lit(0), F.col("lot_of") - 1)).alias("lot"))
        to_parts = lots.select("doc", "cluster", "component", F.explode(F.sequence(F.lit(0), F.col("part_of") - 1)).alias("part"), "lot")
        both = to_lots.unionByName(to_parts).select("doc", "cluster", F.xxhash64("component", "part", "lot").alias("group")).distinct()
        return found.unionByName(self.solved(both, "simhash-rest"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = NET_BITS, least: float = ALIKE, width: int = ALIKE_WIDTH) -> DataFrame:
    """``docs`` without near-copies, with their own columns.

    Two documents are linked if the Jaccard similarity of their shingles of ``width`` words is ``least`` or more; of every
    connected component of such links the document of the smallest key stays. Texts of the same words are one text first;
    the others are compared if a candidate link or a chain of them joins them, all with all. Null and empty texts have one
    and the same shingle. Of rows with the same key all stay or go. Rows with a null key stay.
    """
    sketches = staged(_sketches(docs, key, text, width), "simhash-sketches")
    of_text = [F.first(c).alias(c) for c in sketches.columns if c not in ("doc", "same")]
    classes = staged(sketches.groupBy("same").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), *of_text), "simhash-texts")
    copies = hot_join(sketches.select("doc", "same"), classes.select("same", "n", F.col("doc").alias("first")), "same", "n", sketches.count())
    copies = copies.where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
    found = connected_components(_candidates(classes, budget), "a", "b").withColumnRenamed("node", "doc")
    members = staged(classes.groupBy("doc").agg(F.sum(F.col("chars") + ROW).alias("size")).join(found, "doc"), "simhash-members")
    links = _Verifier(docs, key, text, least, width).links(members).unionByName(copies)
    gone = staged(connected_components(links, "a", "b").where("node <> component").select(F.col("node").alias(key)), "simhash-copies")
    return docs.join(gone, key, "left_anti").select(*docs.columns)

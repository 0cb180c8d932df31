"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists.

``index`` cuts the documents into shards of about SHARD postings, where they lie, without a shuffle. A shard has, for each
of its terms, the list of the documents that hold it, by falling impact. ``search`` gives every shard all queries, in blocks
of at most BLOCK bytes of terms. In a shard a query's lists are read side by side, STEP postings of each list a round at
first; documents that a round shows are scored whole from the shard's forward index. The weighted sum of the impacts last
read bounds the score of what no list has shown yet: when it falls strictly below the kth score so far, nothing unseen can
reach the answer, ties included, and reading stops. The k best found so far go with a task from shard to shard, so that
later shards stop early; the tasks' bests are merged by rank.

Terms are maximal runs of characters other than ASCII ones that are neither letters nor digits, with A-Z lower-cased. Each
row is a document of its own, also where keys repeat; rows of one query key are one query, with every term once. Null and
empty texts, and texts without a term, are in no list and are not counted; a query without a term that a document holds gets
no rows. Texts are read whole, however long. Of equal scores the smaller key comes first, and a null key last; equal keys
take a rank each. An empty table on either side gives an empty result. Columns other than those named are not read, so
their names may be anything.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filamenta.llm.memory import give_back
from filamenta.session import staged

#: Postings of a shard, postings read of each list in a first round, and bytes of query terms that go to every task at once.
SHARD, STEP, BLOCK = 1 << 19, 32, 8 << 20
#: Shards of a Parquet row group. A task holds a row group at once, and Parquet looks at its size only after 100 rows.
GROUP = 2
_WORD = [chr(b) if chr(b).isalnum() and b < 128 else "" for b in range(256)]
#: One byte for another: A-Z to a-z, other ASCII characters than letters and digits to a space; bytes over 127 stay.
TABLE = bytes(ord(c.lower()) if c else b if b > 127 else 32 for b, c in enumerate(_WORD))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for t in batch.column(0):
            n = len(terms_of(t.as_py()))
            docs += n > 0
            terms += n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])


def length_norm(n: int, docs: int, terms: int) -> int:
    """A document's m: 50, and 50 more at the mean length."""
    return 100 - 50 + (50 * n * docs) // terms


class _Shard:
    """The documents of a shard while it is made."""

    def __init__(self) -> None:
        self.names: defaultdict[bytes, int] = defaultdict()
        self.names.default_factory = self.names.__len__
        self.term, self.tf, self.distinct, self.n, self.keys = array("i"), array("i"), [], [], []

    def add(self, key, words: list[bytes]) -> None:
        counts = Counter(words)
        self.term.extend(map(self.names.__getitem__, counts))
        self.tf.extend(counts.values())
        self.distinct.append(len(counts))
        self.n.append(len(words))
        self.keys.append(key)

    def row(self, kind: pa.DataType, docs: int, terms: int) -> pa.RecordBatch:
        m = np.array([length_norm(n, docs, terms) for n in self.n], np.int64)
        doc = np.repeat(np.arange(len(m), dtype=np.int32), self.distinct)
        tf = np.frombuffer(self.tf, np.int32).astype(np.int64)
        impact = (1_000_000_000 * tf // (1000 * tf + 20 * m[doc])).astype(np.int32)
        term = np.frombuffer(self.term, np.int32)
        order = np.lexsort((doc, -impact, term))
        held = np.bincount(term, minlength=len(self.names))
        values = [list(self.names), held.astype(np.int32), doc[order].tobytes(), impact[order].tobytes(), self.keys]
        types = [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(kind)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["terms", "held", "docs", "impacts", "keys"])


def index(documents: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> tuple[DataFrame, int]:
    """(shards, number of documents with a term). shards: terms, held (documents a term), docs and impacts list by list, keys."""
    totals = documents.select(text).mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    docs, terms = totals[0] or 0, totals[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = _Shard(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(*batch.columns, strict=True):
                if words := terms_of(t.as_py()):
                    now.add(k.as_py(), words)
                    if len(now.term) >= shard:
                        yield now.row(kind, docs, terms)
                        now = _Shard()
        if now.n:
            yield now.row(kind, docs, terms)
        del now
        give_back()

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"terms array<binary>, held array<int>, docs binary, impacts binary, keys array<{kind}>"
    return staged(rows.mapInArrow(run, schema), "threshold-index", **{"parquet.block.row.count.limit": str(GROUP)}), docs


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            terms = sorted(set(terms_of(batch.column(1)[k].as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).take(pa.array([0] * len(terms), pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])


def weighted(queries: DataFrame, shards: DataFrame, docs: int, item: str, text: str) -> DataFrame:
    """(item, terms, weights, bytes): a query's terms that some document holds. A document frequency is the sum over all shards."""
    kind = queries.schema[item].dataType.simpleString()
    asked = staged(queries.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(_query_terms, f"item {kind}, term binary").distinct(), "threshold-terms")
    lists = shards.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    w = F.floor(1000 * F.log((F.lit(docs) * 2 + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    each = asked.join(df, "term").withColumn("w", w)
    out = each.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t"), F.sum(F.length("term") + 64).alias("bytes"))
    return out.select("item", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), "bytes")


def threshold_top(lists: list[tuple[np.ndarray, np.ndarray]], weights: list[int], count: int, scores_of, best: list[tuple], key_of, k: int, step: int = STEP) -> list[tuple]:
    """``best``, up to k tuples (-score, key is null, key) in order, with the documents of these impact-sorted lists."""
    lengths = np.array([len(d) for d, _ in lists])
    w = np.array(weights, np.int64)
    seen, at, longest = np.zeros(count, bool), 0, int(lengths.max(initial=0))
    while at < longest:
        fresh = np.unique(np.concatenate([d[at : at + step] for d, _ in lists]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        if len(fresh):
            scores = scores_of(fresh)
            least = max(1, -best[-1][0] if len(best) == k else 1)
            good = np.flatnonzero(scores >= least)
            if len(good) > k:  # ties with the kth stay
                good = good[scores[good] >= -np.partition(-scores[good], k - 1)[k - 1]]
            if len(good):
                best = sorted(best + [(-int(scores[g]), (key := key_of(int(fresh[g]))) is None, key) for g in good], key=_order)[:k]
        at, step = at + step, min(4 * STEP, step + STEP // 2)
        last = np.array([imp[at - 1] if at < len(imp) else 0 for _, imp in lists], np.int64)
        if len(best) == k and int((w * last).sum()) < -best[-1][0]:
            break
    return best


def _order(entry: tuple) -> tuple:
    return (entry[0], entry[1], 0 if entry[1] else entry[2])


def _search(asked: list[tuple], k: int, item_kind: pa.DataType):
    """The k best of each of ``asked`` (item, terms, weights) among a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sorted({t for _, terms, _ in asked for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        queries = [(np.array([number[t] for t in terms], np.int64), np.array(w, np.int64)) for _, terms, w in asked]
        best: list[list[tuple]] = [[] for _ in asked]
        weight, kind = np.zeros(len(vocabulary), np.int64), None
        for batch in batches:
            kind = batch.schema.field(4).type.value_type
            for r in range(batch.num_rows):
                ends = np.cumsum(batch.column(1)[r].values.to_numpy())
                docs, impacts = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int32) for c in (2, 3))
                keys = batch.column(4)[r].values
                place = np.full((len(vocabulary), 2), 0, np.int64)
                for j, t in enumerate(batch.column(0)[r].values.to_pylist()):
                    if (v := number.get(t)) is not None:
                        place[v] = ends[j - 1] if j else 0, ends[j]
                # the forward index: by document, the terms that some query asks for
                sizes = place[:, 1] - place[:, 0]
                which = np.repeat(np.arange(len(vocabulary)), sizes)
                where = np.arange(len(which)) + np.repeat(place[:, 0] - (np.cumsum(sizes) - sizes), sizes)
                by_doc = np.argsort(docs[where], kind="stable")
                f_term, f_impact = which[by_doc], impacts[where][by_doc].astype(np.int64)
                f_ends = np.cumsum(np.bincount(docs[where], minlength=len(keys)))
                f_starts = np.r_[0, f_ends[:-1]]

                def scores_of(found: np.ndarray) -> np.ndarray:
                    size = f_ends[found] - f_starts[found]
                    total = np.cumsum(size)
                    at = np.arange(total[-1]) + np.repeat(f_starts[found] - (total - size), size)
                    run = np.r_[0, np.cumsum(weight[f_term[at]] * f_impact[at])]
                    return run[total] - run[total - size]

                for q, (terms, w) in enumerate(queries):
                    here = place[terms]
                    some = here[:, 1] > here[:, 0]
                    if some.any():
                        weight[terms] = w
                        lists = [(docs[a:b], impacts[a:b]) for a, b in here[some]]
                        best[q] = threshold_top(lists, w[some].tolist(), len(keys), scores_of, best[q], lambda d: keys[d].as_py(), k)
                        weight[terms] = 0
        rows = [(q, -s, key) for q, found in enumerate(best) for s, _, key in found]
        if rows:
            items = pa.array([asked[q][0] for q, _, _ in rows], item_kind)
            yield pa.RecordBatch.from_arrays([items, pa.array([s for _, s, _ in rows], pa.int64()), pa.array([key for *_, key in rows], kind)], ["item", "score", "key"])
        give_back()

    return run


def search(documents: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", item: str = "item_id", text: str = "text", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): the k highest-scoring documents of every query, rank from 1; only scores above 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    shards, docs = index(documents, key, text, shard)
    asked = staged(weighted(queries, shards, docs, item, text), "threshold-queries")
    blocks = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // block))
    kinds = {c: documents.schema[c].dataType if c == key else queries.schema[c].dataType for c in (key, item)}
    schema = f"item {kinds[item].simpleString()}, score long, key {kinds[key].simpleString()}"
    parts = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms", "weights").collect()  # about ``block`` bytes
        parts.append(shards.mapInArrow(_search([(r[0], [bytes(t) for t in r[1]], r[2]) for r in held], k, to_arrow_type(kinds[item])), schema))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")

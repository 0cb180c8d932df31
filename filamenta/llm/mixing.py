"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Every document has a token weight and a cell (source, language, topic). Token sums by cell are the seed; raking scales
them, one marginal after the other, until each marginal has its target shares. A cell's multiplier over the seed, scaled
so that the largest is 1, is the probability with which its documents stay. The draw is a hash of the key, or of the whole
row where the key is null, so a run can be repeated, and no cell is dealt to one task: sums are aggregated before they move,
and only the table of cells, whose size is the product of the numbers of sources, languages and topics, is collected,
measured and joined back by broadcast.

The default targets move every marginal from its observed shares towards equal ones by the power TEMPERATURE, which
keeps about six in ten documents where one source holds a third. A value that a given target does not name gets weight
0; a target's value without documents is left out and the rest rescaled. Targets that cannot all be met are warned of.
Nulls in source, language or topic are a value of their own. Null or empty texts weigh one token; texts are whole, however
long. Repeated rows weigh as often as they occur and are drawn alike. An empty table gives an empty result. ``sampled``
leaves columns of any name alone; ``mixed`` adds two, which replace columns of their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL = "\x00null"
TEMPERATURE = 0.9
TOLERANCE, ROUNDS = 1e-9, 500
#: Topics by size of words and lines: a stand-in for a topic column where the table has none.
TOPICS = ("short", "prose", "long")
#: Cells beyond this are refused rather than collected.
MOST_CELLS = 1_000_000


def token_weight(text: Column) -> Column:
    """Words between single spaces, at least one: a cheap count that needs no tokenizer."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """The length class of a text: up to 100 words, up to 1000, more."""
    n = token_weight(text)
    return F.when(n <= 100, TOPICS[0]).when(n <= 1000, TOPICS[1]).otherwise(TOPICS[2])


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Multiplier of each cell so that the weighted cells have the target shares along every axis.

    Axes are fitted in turn until no share is off by more than ``tolerance``; targets that cannot all be met (cells that
    would be needed are empty) stop after ``rounds`` at the last axis's fit, with a warning.
    """
    live = {c: float(w) for c, w in cells.items() if w > 0 and all(targets[a].get(c[a], 0.0) > 0 for a in range(len(targets)))}
    total = sum(live.values())
    fit = dict(live)
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(targets):
            sums: dict = {}
            for c, w in fit.items():
                sums[c[axis]] = sums.get(c[axis], 0.0) + w
            present = sum(target[v] for v in sums)
            factor = {v: target[v] / present * total / s for v, s in sums.items()}
            worst = max([worst, *(abs(s / total - target[v] / present) for v, s in sums.items())])
            fit = {c: w * factor[c[axis]] for c, w in fit.items()}
        if worst <= tolerance:
            break
    else:
        warnings.warn(f"targets are not met together: the shares of one axis are still off by {worst:.2g} after {rounds} rounds", stacklevel=2)
    return {c: fit[c] / live[c] if c in live else 0.0 for c in cells}


def tempered(cells: dict[tuple, float], axis: int, power: float = TEMPERATURE) -> dict:
    """Target shares of an axis: observed shares to ``power``, rescaled."""
    sums: dict = {}
    for c, w in cells.items():
        sums[c[axis]] = sums.get(c[axis], 0.0) + w
    total = sum(sums.values()) or 1.0
    shares = {v: (s / total) ** power for v, s in sums.items()}
    whole = sum(shares.values()) or 1.0
    return {v: s / whole for v, s in shares.items()}


def draw(key: Column, row: list[Column]) -> Column:
    """A number in [0, 1) from a hash of the key, or of the row's columns where the key is null."""
    h = F.when(key.isNull(), F.xxhash64(F.lit("mix:row"), *row)).otherwise(F.xxhash64(F.lit("mix:key"), key))
    return F.shiftrightunsigned(h, 11) / F.lit(2.0**53)


def _cell(axes: list[Column]) -> list[Column]:
    return [F.coalesce(a.cast("string"), F.lit(NULL)) for a in axes]


def cell_weights(docs: DataFrame, axes: list[Column], weight: Column) -> dict[tuple, float]:
    """Token sums by cell."""
    named = [c.alias(f"axis{i}") for i, c in enumerate(_cell(axes))]
    sums = docs.select(*named, weight.alias("w")).groupBy(*[f"axis{i}" for i in range(len(axes))]).agg(F.sum("w").alias("w"))
    rows = sums.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"over {MOST_CELLS} cells; use axes with fewer values")
    return {tuple(r)[:-1]: float(r["w"]) for r in rows}


#: Names that no table has: the cell's probability, and whether the row is drawn.
NAMES = ("\x02keep_probability", "\x02kept")


def _mixed(docs: DataFrame, axes: list[Column] | None, weight: Column | None, targets: list[dict] | None, key: str, text: str) -> DataFrame:
    """``docs`` with columns NAMES."""
    axes = axes or [F.col("source"), F.col("lang"), topic_of(F.col(text))]
    weight = token_weight(F.col(text)) if weight is None else weight
    cells = cell_weights(docs, axes, weight)
    goal = targets or [tempered(cells, a) for a in range(len(axes))]
    factor = rake(cells, goal)
    top = max(factor.values(), default=1.0) or 1.0
    spark, columns = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    known = spark.createDataFrame([("\x01".join(c), f / top) for c, f in factor.items()], "cell string, p double")
    drawn = draw(F.col(key), [c for c, f in zip(columns, docs.schema.fields, strict=True) if "map" not in f.dataType.simpleString()])
    rows = docs.select(F.struct(*columns).alias("row"), F.concat_ws("\x01", *_cell(axes)).alias("cell"), drawn.alias("draw"))
    p = F.coalesce("p", F.lit(0.0))
    out = rows.join(F.broadcast(known), "cell", "left").select("row.*", p.alias(NAMES[0]), (F.col("draw") < p).alias(NAMES[1]))
    return out


def mixed(docs: DataFrame, axes: list[Column] | None = None, weight: Column | None = None, targets: list[dict] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``keep_probability`` (double) and ``kept`` (boolean): every row, with its cell's probability."""
    others = [c for c in docs.columns if c not in ("keep_probability", "kept")]
    out = _mixed(docs, axes, weight, targets, key, text)
    return out.select(*[F.col(f"`{c}`") for c in others], F.col(NAMES[0]).alias("keep_probability"), F.col(NAMES[1]).alias("kept"))


def sampled(docs: DataFrame, axes: list[Column] | None = None, weight: Column | None = None, targets: list[dict] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are drawn, with their own columns."""
    return _mixed(docs, axes, weight, targets, key, text).where(F.col(NAMES[1])).select(*[F.col(f"`{c}`") for c in docs.columns])

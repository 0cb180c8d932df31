"""Secret spans: three fixed patterns, and a randomness test battery over other key-like runs.

Everything is a column expression: no Python runs on the executors.

Candidates of the battery are maximal runs of ``[A-Za-z0-9+/_-]`` of at least MIN_LENGTH characters that overlap no base
span. The encoding is inferred from the characters that occur (hex, base32, base62, base64), and four statistics are
compared with what uniform draws from that encoding would give: chi-squared over symbols, chi-squared over character
classes, the number of class runs, and the lag-one serial correlation. The smallest p-value, Bonferroni-corrected, is the
candidate's.

What the false-discovery control bounds: a candidate is dropped only as a discovery that it is not random. Within each
(encoding, length band) stratum Benjamini-Hochberg at level ALPHA makes these discoveries, so that at most that share of
what is dropped is expected to be random, that is, a secret lost; the rest is reported as kind ``random``. How much of what
is reported is no secret depends on the tests' power, which grows with length. Bands make the control length-aware: short
runs, on which the tests have little power, do not loosen the bar for long ones. The last band holds all runs of
MIN_LENGTH x 2^4.5 characters or more, where the tests hardly miss. Levels come from a histogram over all rows with a
bounded number of cells (strata x P_BINS), so only that goes to the driver.

Null and empty texts have no spans. Texts are whole; spans are placed in chunks of CHUNK, so that a text with very many
costs little more than one pass. Offsets are code points, ends exclusive. Ties and repeated rows are judged alike. An empty
table gives an empty result. ``scan_report`` and ``redacted`` leave columns of any name alone; ``secret_spans`` adds
``base`` and ``spans``, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filamenta.session import staged

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more: the same matches, as runs are maximal
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"

MIN_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
ALPHA = 0.05
P_BINS = 400
CHUNK = 128
#: Alphabets by which symbols get numbers.
ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of upper-case letters, lower-case letters, digits and others in each alphabet.
SHARES = {"hex": (6 / 16, 0, 10 / 16, 0), "base32": (26 / 32, 0, 6 / 32, 0), "base62": (26 / 62, 26 / 62, 10 / 62, 0), "base64": (26 / 64, 26 / 64, 10 / 64, 2 / 64)}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start,kind,end,s>> of the pattern's leftmost non-overlapping matches that pass ``keep``."""
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,s:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["s"].alias("s")))
        return F.struct(end.alias("at"), F.concat(acc["spans"], one).alias("spans"))

    def chunk(acc: Column, part: Column) -> Column:
        own = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["parts"], F.array(x["spans"])).alias("parts"))
        return F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("spans")), step, own)

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        zipped = F.zip_with(gaps, found, lambda g, s: F.struct(g.alias("gap"), s.alias("s")))
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))
        parts = _let(zipped, lambda z: F.transform(numbers, lambda c: F.slice(z, c * CHUNK + 1, F.lit(CHUNK))))
        none = F.expr("cast(array() as array<array<struct<start:int,kind:int,end:int,s:string>>>)")
        spans = F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("parts")), chunk, lambda acc: acc["parts"]))
        return F.when(F.size(found) > 0, F.filter(spans, keep) if keep is not None else spans).otherwise(empty)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def with_matches(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns, by start and then kind) and ``loose`` (candidates of the battery)."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_enough = lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6
    out = df.withColumn("base", F.array_sort(_bare(F.concat(_matches(t, ASSIGN, 0, long_enough), _matches(t, ACCESS, 1), _matches(t, HEX, 2)))))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out.withColumn("loose", F.filter(_matches(t, CANDIDATE, 3), apart))


def _count(s: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(s, drop, "")).cast("double")


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation that is good to 1e-7."""

    def half(x: Column) -> Column:
        fit = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) / 2
        return _let(1 / (1 + 0.3275911 * x), fit) * F.exp(-x * x)

    return _let(F.struct(z.alias("z"), _let(F.abs(z) / F.sqrt(F.lit(2.0)), half).alias("h")), lambda v: F.when(v["z"] > 0, v["h"]).otherwise(1 - v["h"]))


def _tests(s: Column, encoding: Column) -> Column:
    """The battery's p-value of a string, held against uniform draws from the encoding's alphabet."""
    facts = {
        name: F.struct(
            F.lit(float(len(letters))).alias("k"),
            F.lit(letters).alias("letters"),
            F.array(*[F.lit(float(p)) for p in SHARES[name]]).alias("shares"),
            F.lit(float(sum(p > 0 for p in SHARES[name]) - 1)).alias("df"),
            F.lit(1 - sum(p * p for p in SHARES[name])).alias("change"),
        )
        for name, letters in ALPHABETS.items()
    }
    known = F.element_at(F.create_map(*[x for name, f in facts.items() for x in (F.lit(name), f)]), encoding)
    plain = F.when(encoding == "hex", F.upper(s)).otherwise(F.translate(s, "-_", "+/"))
    start = F.struct(plain.alias("s"), F.length(s).cast("double").alias("n"), F.filter(F.split(plain, ""), lambda c: c != "").alias("chars"), known.alias("e"))

    def statistics(a: Column) -> Column:
        s, n, chars, e = a["s"], a["n"], a["chars"], a["e"]
        k, df, change = e["k"], e["df"], e["change"]
        # chi-squared over symbols; the sum of squared counts is the sum over characters of how often each occurs
        squares = F.aggregate(chars, F.lit(0.0), lambda t, c: t + (F.length(s) - F.length(F.replace(s, c, F.lit("")))))
        symbols = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        counts = F.array(_count(s, "[^A-Z]"), _count(s, "[^a-z]"), _count(s, "[^0-9]"), _count(s, "[A-Za-z0-9]"))
        parts = F.zip_with(counts, e["shares"], lambda c, p: F.when(p > 0, (c - n * p) * (c - n * p) / F.nullif(n * p, F.lit(0.0))).otherwise(0.0))
        classes = F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)
        # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
        classes = (F.pow(classes / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        collapsed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0"), "[+/]+", "+")
        runs = F.abs((F.length(collapsed) - 1 - (n - 1) * change) / F.sqrt((n - 1) * (change * (1 - change))))
        values = F.transform(chars, lambda c: F.instr(e["letters"], c).cast("double") - (k + 1) / 2)
        pairs = lambda v: F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda x, y: x * y)
        serial = F.abs(F.aggregate(_let(values, pairs), F.lit(0.0), lambda t, x: t + x) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
        # one-sided statistics count once, two-sided ones twice
        return F.array(*[F.struct(z.alias("z"), F.lit(w).alias("w")) for z, w in ((symbols, 1.0), (classes, 1.0), (runs, 2.0), (serial, 2.0))])

    p = F.array_min(F.transform(_let(start, statistics), lambda t: F.least(F.lit(1.0), t["w"] * _upper_tail(t["z"]))))
    return F.least(F.lit(1.0), 4 * p)


def _encoding(s: Column) -> Column:
    """Hex, base32, base62 or base64 by the characters that occur; null where a run is a word, a number or a path of words."""
    return (
        F.when(s.rlike("^[0-9]+$") | s.rlike("^[A-Za-z]?[a-z/_+-]+$") | s.rlike("^[A-Z/_+-]+$"), None)
        .when(s.rlike("^([0-9A-F]+|[0-9a-f]+)$"), "hex")
        .when(s.rlike("^[A-Z2-7]+$"), "base32")
        .when(s.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )


def judged(df: DataFrame) -> DataFrame:
    """``loose`` becomes array<struct<start,kind,end,stratum,p>>, without runs that are plainly words or numbers."""

    def one(x: Column) -> Column:
        band = F.least(F.floor(F.log2((x["end"] - x["start"]) / F.lit(MIN_LENGTH)) * 2), F.lit(9))
        p = F.greatest(_tests(x["s"], x["e"]), F.lit(2.0 ** -(P_BINS / 4)))
        return F.struct(x["start"], x["kind"], x["end"], F.concat_ws("-", x["e"], band.cast("string")).alias("stratum"), p.alias("p"))

    named = F.transform("loose", lambda x: F.struct(x["start"], x["kind"], x["end"], x["s"], _encoding(x["s"]).alias("e")))
    return df.withColumn("loose", F.transform(F.filter(named, lambda x: x["e"].isNotNull()), one))


def rejection_levels(candidates: DataFrame) -> dict[str, float]:
    """By stratum, the largest p at which Benjamini-Hochberg rejects randomness. Reads ``loose``; at most strata x P_BINS cells reach the driver."""
    cells = (
        candidates.select(F.explode("loose").alias("c"))
        .groupBy(F.col("c.stratum").alias("stratum"), F.floor(-F.log2("c.p") * 4).alias("bin"))
        .count()
        .collect()
    )
    levels: dict[str, float] = {}
    for stratum in {c["stratum"] for c in cells}:
        mine = sorted((c["bin"], c["count"]) for c in cells if c["stratum"] == stratum)
        total, below = sum(n for _, n in mine), 0
        for b, n in reversed(mine):  # from the smallest p-values up
            below += n
            edge = 2.0 ** (-b / 4)
            if edge * total / below <= ALPHA:
                levels[stratum] = edge
    return levels


def decided(df: DataFrame, levels: dict[str, float]) -> DataFrame:
    """``spans``: base spans and candidates that pass as random, by start and then kind."""
    at = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]) if levels else F.expr("cast(map() as map<string,double>)")
    held = _bare(F.filter("loose", lambda x: x["p"] > F.coalesce(F.element_at(at, x["stratum"]), F.lit(0.0))))
    return df.withColumn("spans", F.array_sort(F.concat("base", held))).drop("loose")


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``, arrays of (start, kind number, end). Levels are set over all rows of ``df``."""
    found = judged(with_matches(df, text))
    return decided(found, rejection_levels(found.select("loose")))


def redacted(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mask``; overlapping spans become one. Rows and columns are kept.

    The texts are scanned for the levels and again for the masking, which takes less memory and disk than to keep the
    candidates beside whole texts.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("text"))
    found = judged(with_matches(rows))
    out = decided(found, rejection_levels(found.select("loose")))
    t = F.col("text")

    def merged(acc: Column, x: Column) -> Column:
        """Where each stretch outside all spans begins and ends."""
        fresh = x["start"] >= acc["at"]
        gap = F.array(F.struct(acc["at"].alias("a"), x["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")
    last = lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("a"), F.length(t).alias("b"))))
    gaps = F.aggregate("spans", F.struct(F.lit(0).alias("at"), none.alias("gaps")), merged, last)
    whole = F.array_join(F.transform(gaps, lambda g: F.substring(t, g["a"] + 1, g["b"] - g["a"])), mask)
    masked = F.when(F.size("spans") > 0, whole).otherwise(t)
    return out.select(*[masked.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def scan_report(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, the digest of the base spans and all spans as text."""
    found = staged(judged(with_matches(docs.select("doc_id", "text"))).drop("text"), "secret-candidates")
    out = decided(found, rejection_levels(found))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))

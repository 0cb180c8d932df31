"""LAMMPS data files: a reader that deals a file's bytes to tasks, fibers from bonds, and a writer.

Spark's text source splits a file into byte ranges; a line's place is its file, the range's first byte and its row there. The
section keywords, a few lines, are found in a first pass, and with their places every line knows its section. Only these and
the header's lines reach the driver. Atom and bond rows are parsed as columns. A folder of parts, as ``write_data`` makes, is
read as one file in the order of the parts' names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filamenta.functions import geometry as g
from filamenta.operators import matching
from filamenta.operators.graph import connected_components, forest
from filamenta.operators.numbering import numbered
from filamenta.session import staged

#: Columns of an atom row by style: a fixed part of the file format.
STYLES = {
    "atomic": "id type x y z",
    "bond": "id molecule type x y z",
    "angle": "id molecule type x y z",
    "molecular": "id molecule type x y z",
    "charge": "id type q x y z",
    "full": "id molecule type q x y z",
    "sphere": "id type diameter density x y z",
    "bpm/sphere": "id molecule type diameter density x y z",
}
#: Section keywords of the file format.
SECTIONS = """Atoms|Bonds|Velocities|Masses|Angles|Dihedrals|Impropers|Ellipsoids|Lines|Triangles|Bodies|Atom Type Labels|Bond Type Labels|Angle Type Labels|
Dihedral Type Labels|Improper Type Labels|Pair Coeffs|PairIJ Coeffs|Bond Coeffs|Angle Coeffs|Dihedral Coeffs|Improper Coeffs""".replace("\n", "").split("|")
#: Without bonds, a sphere that is more diameters than this from the one before it begins a fiber of its own.
UNBONDED_GAP = 1.5
HEADER_LINES = 10_000


class LammpsError(ValueError):
    """A file that cannot be read; ``code`` is stable."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def columns_of(style: str) -> list[str]:
    """An atom row's columns. A hybrid's are id, type, x, y, z, and then what its styles add, each once."""
    words = [w for w in style.split() if not re.fullmatch(r"[-+.\deE]+", w)]
    hybrid = words[:1] == ["hybrid"]
    names = words[1:] if hybrid else words
    if not names or (len(names) > 1 and not hybrid) or any(n not in STYLES for n in names):
        raise LammpsError("unknown_style", style)
    out = ["id", "type", "x", "y", "z"] if hybrid else []
    for n in names:
        out += [c for c in STYLES[n].split() if c not in out]
    return out


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line, note): lines without comments, their place in the file, and the comment."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r"))
    cut = F.split("value", "#", 2)
    return raw.select(F.struct("f", "b", "r").alias("at"), F.trim(F.regexp_replace(cut[0], r"[\s]+", " ")).alias("line"), F.trim(F.get(cut, F.lit(1))).alias("note"))


def _place(at) -> Column:
    return F.struct(F.lit(at["f"]).alias("f"), F.lit(at["b"]).cast("long").alias("b"), F.lit(at["r"]).cast("long").alias("r"))


def _header(lines: list[str]) -> dict:
    """Counts by name, and the box as x, y, z: (low, high)."""
    out: dict = {}
    for line in lines:
        words = line.split()
        if len(words) == 4 and words[2:] in ([f"{c}lo", f"{c}hi"] for c in "xyz"):
            out[words[2][0]] = (float(words[0]), float(words[1]))
        elif words[3:] == ["xy", "xz", "yz"]:
            if any(float(w) for w in words[:3]):
                raise LammpsError("tilted_box", line)
        elif words and (words[-1] in ("avec", "bvec", "cvec") or words[-2:] == ["abc", "origin"]):
            raise LammpsError("tilted_box", line)
        elif words and words[0].isdigit():
            out[" ".join(words[1:])] = int(words[0])
    if missing := [c for c in "xyz" if c not in out]:
        raise LammpsError("no_box", f"no {missing[0]}lo {missing[0]}hi line")
    return out


def read_data(spark: SparkSession, path: str, style: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(atoms, bonds, header) of one file. atoms: id, molecule, type, diameter, x, y, z, ix, iy, iz; bonds: id, type, a, b.

    ``style`` overrides the comment beside Atoms, without which bpm/sphere is read. A type that is a label is the label's
    number. header has the counts, the box by axis, ``style``, and ``images``: whether atom rows have image flags.
    """
    lines = _lines(spark, path)
    mark = F.when(F.col("line").isin(SECTIONS), F.struct("at", "line", "note"))
    seen = lines.agg(F.min("at").alias("first"), F.collect_list(mark).alias("marks")).first()
    first, starts = seen["first"], sorted((r["at"], r["line"], r["note"]) for r in seen["marks"])  # the first line is a title, whatever it says

    def between(low, high) -> DataFrame:
        """Lines that say something, after ``low`` and before ``high``; files that hold none of them are not read."""
        rows = lines.where(F.col("line") != "")
        if low is not None:
            rows = rows.where((F.col("at.f") >= low["f"]) & (F.col("at") > _place(low)))
        return rows if high is None else rows.where((F.col("at.f") <= high["f"]) & (F.col("at") < _place(high)))

    top = between(None, starts[0][0] if starts else None).orderBy("at").limit(HEADER_LINES).collect()
    header = _header([r["line"] for r in top if r["at"] != first])

    def section(name: str) -> DataFrame:
        at = [k for k, (_, n, _) in enumerate(starts) if n == name]
        if not at:
            return lines.limit(0).withColumn("p", F.split("line", " "))
        rows = between(starts[at[0]][0], starts[at[0] + 1][0] if at[0] + 1 < len(starts) else None)
        return rows.withColumn("p", F.split("line", " "))

    noted = next((note for _, n, note in starts if n == "Atoms" and note), "")
    style = style or noted or "bpm/sphere"
    names = columns_of(style)
    rows = section("Atoms")
    good = [len(names), len(names) + 3]
    pick = lambda n: F.when(F.col("w").isin(good), F.get("p", F.lit(names.index(n)))) if n in names else F.lit(None)
    image = lambda k: F.when(F.col("w") == good[1], F.get("p", F.lit(len(names) + k)))
    parsed = rows.withColumn("w", F.size("p")).select(
        pick("id").cast("long").alias("id"), pick("molecule").cast("long").alias("molecule"), pick("type").alias("kind"), pick("diameter").cast("double").alias("diameter"),
        *[pick(c).cast("double").alias(c) for c in "xyz"], *[F.coalesce(image(k).cast("int"), F.lit(0)).alias(f"i{c}") for k, c in enumerate("xyz")], "w",
    )
    ready = staged(parsed, "lammps-rows")  # the text is parsed once
    widths = {r["w"]: r["count"] for r in ready.groupBy("w").count().collect()}
    if bad := set(widths) - set(good):
        raise LammpsError("row_width", f"{min(bad)} values, but atom style {style!r} has {len(names)} ({' '.join(names)}), or {len(names) + 3} with image flags")
    if sum(widths.values()) != header.get("atoms", 0):
        raise LammpsError("row_count", f"the header gives {header.get('atoms', 0)} atoms, but the Atoms section has {sum(widths.values())}")
    numbers = lambda name: section(name).select(F.element_at("p", 1).cast("int").alias("label_id"), F.expr("substring(line, locate(' ', line) + 1)").alias("label"))
    has = lambda name: any(n == name for _, n, _ in starts)
    named = lambda df, name: df.join(numbers(name), F.col("kind") == F.col("label"), "left") if has(name) else df.withColumn("label_id", F.lit(None).cast("int"))
    atoms = named(ready, "Atom Type Labels").select("id", "molecule", F.coalesce("label_id", F.col("kind").try_cast("int")).alias("type"), "diameter", *"xyz", "ix", "iy", "iz")
    if atoms.groupBy("id").count().where("count > 1").limit(1).count():
        raise LammpsError("duplicate_atom", "an atom id occurs twice")
    links = section("Bonds")
    if (n := links.count()) != header.get("bonds", 0):
        raise LammpsError("row_count", f"the header gives {header.get('bonds', 0)} bonds, but the Bonds section has {n}")
    typed = named(links.withColumn("kind", F.col("p")[1]), "Bond Type Labels")
    bonds = typed.select(F.col("p")[0].cast("long").alias("id"), F.coalesce("label_id", F.col("kind").try_cast("int")).cast("long").alias("type"), F.col("p")[2].cast("long").alias("a"), F.col("p")[3].cast("long").alias("b"))
    return atoms, bonds, header | {"style": style, "images": len(names) + 3 in widths}


def periodic_axes(value) -> tuple[bool, bool, bool]:
    """Three flags from axis letters ("xy"), an input script's boundary ("p p f"), one flag or three."""
    if isinstance(value, str):
        words = value.lower().split()
        words = words[1:] if words[:1] == ["boundary"] else words
        if len(words) == 3 and all(set(w) <= set("pfsm") for w in words):
            return tuple(w == "p" for w in words)
        if set("".join(words)) <= set("xyz"):
            return tuple(c in "".join(words) for c in "xyz")
        raise LammpsError("periodic", f"{value!r} names neither axes nor a boundary")
    flags = (value,) * 3 if isinstance(value, bool) else tuple(bool(v) for v in value)
    if len(flags) != 3:
        raise LammpsError("periodic", "three flags are needed")
    return flags


def read_fibers(spark: SparkSession, path: str, style: str | None = None, diameter: float | dict[int, float] | None = None, bond_types: list[int] | None = None, periodic=True) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(fibers, vertices, others, cell) of a data file.

    fibers: fiber_id, type, diameter, atoms; vertices: fiber_id, seq, id, x, y, z, unbroken across periodic faces; others: id
    and why an atom is in no fiber. A fiber is a chain of bonds (of ``bond_types``, where given) inside a molecule, named by
    its smaller end; atoms that are bonded to more than the next one follow their ids. Without bonds, spheres of a molecule
    that lie close follow their ids. The cell is the box, (low, high, periodic) by axis; walls move out to the spheres.
    """
    raw, bonds, header = read_data(spark, path, style)
    flags = dict(zip("xyz", periodic_axes(periodic), strict=True))
    if diameter is not None:
        given = F.lit(float(diameter)) if not isinstance(diameter, dict) else F.create_map(*[x for k, v in diameter.items() for x in (F.lit(int(k)), F.lit(float(v)))])[F.col("type")]
        raw = raw.withColumn("diameter", F.coalesce(given, "diameter"))
    atoms = staged(raw, "lammps-atoms")
    if not atoms.where("diameter is null").isEmpty():
        raise LammpsError("no_diameter", "the atoms have no diameter; give one")
    size = {c: header[c][1] - header[c][0] for c in "xyz"}

    def step(a: Column, b: Column, c: str) -> Column:
        d = b - a
        return d - F.lit(size[c]) * F.rint(d / F.lit(size[c])) if flags[c] else d

    if header.get("bonds", 0):
        ends = atoms.select(F.col("id").alias("n"), F.col("molecule").alias("m"), F.lit(True).alias("there"))
        side = lambda c: ends.select(F.col("n").alias(c), F.col("m").alias(f"m{c}"), F.col("there").alias(f"there_{c}"))
        met = staged(bonds.join(side("a"), "a", "left").join(side("b"), "b", "left"), "lammps-bonds")
        if not met.where("there_a is null or there_b is null").isEmpty():
            raise LammpsError("bad_bond", "a bond names an atom that is not there")
        kept = met.where("a <> b and ma <=> mb") if bond_types is None else met.where(F.col("type").isin(bond_types)).where("a <> b and ma <=> mb")
        pairs = kept.select(F.coalesce("ma", F.lit(-1)).alias("component"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        order, others = _bonded(atoms, staged(pairs, "lammps-links"))
    else:
        order, others = _unbonded(atoms, step)
    rows = atoms.join(order, "id")
    w = Window.partitionBy("fiber_id").orderBy("seq")
    moved = rows.withColumns({f"d{c}": step(F.lag(c).over(w), F.col(c), c) for c in "xyz"})
    start = {c: F.first(F.col(c) + (F.col(f"i{c}") * size[c] if flags[c] else 0.0)).over(w) for c in "xyz"}
    still = F.coalesce((F.col("dx") == 0) & (F.col("dy") == 0) & (F.col("dz") == 0), F.lit(False)).alias("still")
    line = moved.select("fiber_id", "seq", "id", "type", "diameter", still, *[(start[c] + F.sum(F.coalesce(f"d{c}", F.lit(0.0))).over(w)).alias(c) for c in "xyz"])
    vertices = staged(line, "lammps-vertices")
    if not vertices.where("still").isEmpty():
        raise LammpsError("same_point", "two atoms in a row of one fiber are at the same point")
    fibers = vertices.groupBy("fiber_id").agg(F.min_by("type", "seq").alias("type"), F.min_by("diameter", "seq").alias("diameter"), F.count("*").alias("atoms"))
    reach = atoms.agg(*[f for c in "xyz" for f in (F.min(F.col(c) - F.col("diameter") / 2).alias(f"low{c}"), F.max(F.col(c) + F.col("diameter") / 2).alias(f"high{c}"))]).first()
    cell = {c: (*(header[c] if flags[c] or reach[f"low{c}"] is None else (min(header[c][0], reach[f"low{c}"]), max(header[c][1], reach[f"high{c}"]))), flags[c]) for c in "xyz"}
    return fibers, vertices.select("fiber_id", "seq", "id", "x", "y", "z"), others, cell


def _shaped(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """(id, fiber_id, seq, way) of all nodes of pairs a < b that hold whole components; way is path, ids or branch."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    ia, ib = code[: len(a)], code[len(a) :]
    group, of = np.unique(forest(len(names), ia, ib), return_inverse=True)
    group, c = names[group], of[ia]
    size, most = np.bincount(of), np.zeros(len(group), np.int64)
    np.maximum.at(most, of, np.bincount(code))
    order = np.argsort(of, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names)) - np.repeat(np.cumsum(size) - size, size)
    by_id = np.bincount(c[rank[ib] == rank[ia] + 1], minlength=len(group)) == size - 1
    path = (most <= 2) & (np.bincount(c) == size - 1)
    way = np.where(path, "path", np.where(by_id, "ids", "branch"))[of]
    fiber, seq = group[of], rank  # a path whose pairs are all of ids that follow one another has their order
    bent = (path & ~by_id)[c]
    if bent.any():
        p, q, k = (np.concatenate(x) for x in ((ia[bent], ib[bent]), (ib[bent], ia[bent]), (c[bent], c[bent])))
        key = np.lexsort((q, p))
        p, q, k = p[key], q[key], k[key]
        end = np.r_[0, (p[1:] == p[:-1]).astype(np.int64)]  # a node's first or second neighbour
        at, width = p * len(names) + q, len(names)
        other = end[np.searchsorted(at, q * width + p)]
        node, chain, position, _ = matching.in_chains(k, p, end, q, other)
        fiber[node], seq[node] = names[chain], position
    return [names, fiber, seq, way.astype(object)]


def _bonded(atoms: DataFrame, pairs: DataFrame, held: int = matching.CHAIN) -> tuple[DataFrame, DataFrame]:
    """(id, fiber_id, seq) along chains of bonds, and (id, why) of the other atoms.

    ``pairs``: component, a, b; a chain's pairs have one ``component``, which may hold many chains (a molecule does). One of at
    most ``held`` pairs is dealt to a task, many to each; of a larger one the chains are found, and only those that are longer
    are ordered in rounds.
    """
    task = lambda rows: matching.by_component(rows.select("component", "a", "b"), _shaped, "id long, fiber_id long, seq long, way string")

    def larger(rows: DataFrame) -> DataFrame:
        return staged(rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > held).select("component"), "lammps-large")

    far = larger(pairs)
    if far.isEmpty():
        order = staged(task(pairs), "lammps-shaped")
    else:
        near, rest = task(pairs.join(far, "component", "left_anti")), pairs.join(far, "component", "left_semi").select("a", "b")
        found = staged(connected_components(rest, "a", "b"), "lammps-found")
        named = staged(rest.join(found, F.col("a") == F.col("node")).select("component", "a", "b"), "lammps-named")
        far = larger(named)
        order = near.unionByName(task(named.join(far, "component", "left_anti")))
        if not far.isEmpty():
            order = order.unionByName(_bonded_far(named.join(far, "component", "left_semi").select("a", "b"), found.join(far, "component", "left_semi").select("node", "component")))
        order = staged(order, "lammps-shaped")
    ways, order = order.select("id", "way"), order.where("way <> 'branch'").select("id", "fiber_id", "seq")
    why = F.when(F.col("way") == "branch", "bonds branch or close a loop").otherwise("not bonded")
    others = atoms.select("id").join(ways.where("way <> 'branch'").select("id"), "id", "left_anti").join(ways, "id", "left").select("id", why.alias("why"))
    return order, others


def _bonded_far(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, fiber_id, seq, way) for components of any size."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = numbered(found, ["component", "node"])
    named = staged(parts.join(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree")), "node"), "lammps-parts")
    after = named.select((F.col("n") - 1).alias("n"), F.col("node").alias("b"), F.col("component").alias("c"))
    apart = named.join(after, "n").where("component = c").join(pairs, (F.col("node") == pairs["a"]) & (after["b"] == pairs["b"]), "left_anti").select("component").distinct()
    shape = named.groupBy("component").agg(F.max("degree").alias("most"), F.sum("degree").alias("ends"), F.count("*").alias("size"), F.min("n").alias("start"))
    shape = shape.join(apart.withColumn("apart", F.lit(True)), "component", "left")
    way = F.when((F.col("most") <= 2) & (F.col("ends") == 2 * (F.col("size") - 1)), "path").when(F.col("apart").isNull(), "ids").otherwise("branch")
    kinds = staged(named.join(shape.select("component", "start", way.alias("way")), "component").select("node", "component", "way", (F.col("n") - F.col("start")).alias("seq")), "lammps-kinds")
    paths = kinds.where("way = 'path'").select("node")
    side = F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1
    sides = both.join(paths, F.col("a") == F.col("node"), "left_semi").withColumn("e", side)
    links = sides.alias("p").join(sides.alias("q"), (F.col("p.a") == F.col("q.b")) & (F.col("p.b") == F.col("q.a"))).where("p.a < p.b").select(F.col("p.a").alias("a"), F.col("p.e").alias("ea"), F.col("q.a").alias("b"), F.col("q.e").alias("eb"))
    chained = matching.chain_order(paths, links).select("node", "chain", "position")
    seq = F.when(F.col("way") == "path", F.col("position")).otherwise(F.col("seq"))
    ways = kinds.join(chained, "node", "left")
    return ways.select(F.col("node").alias("id"), F.coalesce("chain", "component").alias("fiber_id"), seq.alias("seq"), "way")


def _unbonded(atoms: DataFrame, step) -> tuple[DataFrame, DataFrame]:
    """The same from spheres of a molecule that lie close and follow one another by id."""
    n = numbered(atoms.select("molecule", "id", "diameter", "x", "y", "z"), ["molecule", "id"])
    last = n.select((F.col("n") + 1).alias("n"), F.col("molecule").alias("m"), F.col("id").alias("before"), F.col("diameter").alias("d"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    gap = g.norm(tuple(step(F.col(f"q{c}"), F.col(c), c) for c in "xyz"))
    close = n.join(last, "n").where(F.col("m").eqNullSafe(F.col("molecule")) & (gap <= UNBONDED_GAP * F.greatest("diameter", "d")))
    links = close.select(F.col("before").alias("a"), F.lit(1).alias("ea"), F.col("id").alias("b"), F.lit(0).alias("eb"))
    order = staged(matching.chain_order(atoms.select(F.col("id").alias("node")), staged(links, "lammps-links")), "lammps-order")
    many = order.groupBy("chain").count().where("count > 1").select("chain")
    kept = order.join(many, "chain", "left_semi").select(F.col("node").alias("id"), F.col("chain").alias("fiber_id"), F.col("position").alias("seq"))
    others = order.join(many, "chain", "left_anti").select(F.col("node").alias("id"), F.lit("no sphere close enough").alias("why"))
    return kept, others


def chains(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(fiber_id, seq, id, x, y, z): bonded components that bond consecutive ids, in id order. fiber_id is the smallest id."""
    linked = bonds.select("a", "b").where("a <> b")
    found = connected_components(linked, "a", "b")
    w = Window.partitionBy("fiber_id").orderBy("id")
    rows = atoms.join(found, atoms["id"] == found["node"]).withColumn("fiber_id", F.col("component"))
    return rows.select("fiber_id", (F.row_number().over(w) - 1).alias("seq"), "id", "x", "y", "z")


def write_data(atoms: DataFrame, bonds: DataFrame, box: dict[str, tuple[float, float]], path: str) -> None:
    """A folder of text parts, in order: header, atoms (bpm/sphere) and bonds. Lines are made by executors and sorted there."""
    spark = atoms.sparkSession
    n, m = atoms.count(), bonds.count()
    types = atoms.agg(F.max("type")).first()[0] or 0
    kinds = bonds.agg(F.max("type")).first()[0] or 0
    head = ["Fibers as bonded particles", "", f"{n} atoms", f"{m} bonds", f"{types} atom types", f"{kinds} bond types", ""]
    head += [f"{box[c][0]!r} {box[c][1]!r} {c}lo {c}hi" for c in "xyz"] + ["", "Atoms # bpm/sphere", ""]
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, n long, value string")
    a = atoms.select(F.lit(1).alias("part"), F.col("id").alias("n"), F.concat_ws(" ", "id", "molecule", "type", "diameter", F.lit(1.0), "x", "y", "z").alias("value"))
    mid = spark.createDataFrame([(2, i, x) for i, x in enumerate(["", "Bonds", ""])], "part int, n long, value string")
    b = bonds.select(F.lit(3).alias("part"), F.col("id").alias("n"), F.concat_ws(" ", "id", "type", "a", "b").alias("value"))
    every = lines.unionByName(a).unionByName(mid).unionByName(b)
    every.repartitionByRange("part", "n").sortWithinPartitions("part", "n").select("value").write.text(path)

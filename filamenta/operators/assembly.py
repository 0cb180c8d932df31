"""Fibers added to an assembly of tables, each checked before it is taken.

An assembly is fibers (fiber_id, material_id, section_id), vertices (fiber_id, seq, rx, ry, rz, x, y, z) at rest and placed,
and the ids of materials and sections that exist. A batch of any size is checked by counts and semi joins; what fails is
reported with its first fault and left out, the rest is appended. The faults, in the order in which they count:
geometry_length_mismatch, too_few_vertices, duplicate_fiber_id (also of an id that comes twice in the batch, which takes none
of them), unknown_material, unknown_section. A null id is unknown; a fiber of a null id is not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAULTS = ("geometry_length_mismatch", "too_few_vertices", "duplicate_fiber_id", "unknown_material", "unknown_section")


def faults(new: DataFrame, rest: DataFrame, placed: DataFrame, fibers: DataFrame, materials: DataFrame, sections: DataFrame) -> DataFrame:
    """(fiber_id, material_id, section_id, fault) of a batch; fault is null where a fiber can be taken. ``rest`` and ``placed`` (fiber_id, seq, x, y, z)."""
    count = lambda v, n: v.groupBy("fiber_id").agg(F.count("*").alias(n))
    there = lambda t, c: t.select(c).where(F.col(c).isNotNull()).distinct().withColumn(f"has_{c}", F.lit(True))
    rows = new.select("fiber_id", "material_id", "section_id").join(count(rest, "n_rest"), "fiber_id", "left").join(count(placed, "n_placed"), "fiber_id", "left")
    twice = new.groupBy("fiber_id").agg(F.count("*").alias("times"))
    rows = rows.join(twice, "fiber_id", "left").join(there(fibers, "fiber_id"), "fiber_id", "left").join(there(materials, "material_id"), "material_id", "left").join(there(sections, "section_id"), "section_id", "left")
    n_rest, n_placed = (F.coalesce(c, F.lit(0)) for c in ("n_rest", "n_placed"))
    fault = (
        F.when(n_rest != n_placed, FAULTS[0])
        .when(n_rest < 2, FAULTS[1])
        .when(F.col("has_fiber_id").isNotNull() | (F.col("times") > 1) | F.col("fiber_id").isNull(), FAULTS[2])
        .when(F.col("has_material_id").isNull(), FAULTS[3])
        .when(F.col("has_section_id").isNull(), FAULTS[4])
    )
    return rows.select("fiber_id", "material_id", "section_id", fault.alias("fault"))


def add_fibers(fibers: DataFrame, vertices: DataFrame, new: DataFrame, rest: DataFrame, placed: DataFrame, materials: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fibers, vertices, refused): the assembly with the fibers that pass, their vertices numbered from 0, and the others with their fault."""
    from pyspark.sql import Window

    found = faults(new, rest, placed, fibers, materials, sections)
    taken = found.where("fault is null").drop("fault")
    w = Window.partitionBy("fiber_id").orderBy("seq")
    numbered = lambda v, names: v.join(taken.select("fiber_id"), "fiber_id", "left_semi").select("fiber_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), *[F.col(c).alias(n) for c, n in zip("xyz", names, strict=True)])
    lines = numbered(rest, ("rx", "ry", "rz")).join(numbered(placed, "xyz"), ["fiber_id", "seq"])
    every = vertices.select("fiber_id", F.col("seq").cast("long").alias("seq"), "rx", "ry", "rz", "x", "y", "z").unionByName(lines)
    return fibers.select("fiber_id", "material_id", "section_id").unionByName(taken), every, found.where("fault is not null")

"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A 64-bit fingerprint is cut into segments of two bits; its embedding is the vector of the segments' bit counts. It is cut in
two ways, with neighbouring bits and with bits two apart in a segment, which gives two embeddings of 32 axes, packed into a
long each. The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints.

The axes form 8 groups, one for each byte. Two fingerprints within distance 4 differ in at most 4 groups, so they share all
coordinates, in both embeddings, of at least 4: they meet in a cell of one of the C(8, 4) = 70 grids over four groups. A cell
holds one in 2**31 random fingerprints, so candidates stay few beside the 70 cells of each fingerprint up to billions.

Of a cell with two fingerprints, its least and greatest are the pair. Larger cells are first shrunk: every member within
reach of the cell's least fingerprint is tied to it, which is linear in the cell. Only cells whose members are then in
different components stay open. An open cell of more than SMALL_CELL members is cut again along the four groups that its grid
leaves out, by the distance of 4 that is left for them: two members either share one of these groups too, and meet in its
smaller cell, or they differ by one bit in each, so that the range of each group's count that one can reach in the other is one
up or one down, and only members whose counts are odd where the other's are even are paired. No link is lost; a pair is emitted only if the Hamming distance confirms it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import joined, ship, spread, written
from sparkscour.llm.components import components
from sparkscour.llm.simhash_kernel import SEED, SHINGLE_WORDS, simhash

MAX_BITS = 4
GROUPS = 8
#: Lower bit of every segment of two bits.
LOW = 0x5555555555555555
#: Fingerprints whose cells one task makes: about 50 MB of rows.
TASK = 1 << 14
#: Most members of an open cell whose pairs are formed without cutting it again.
SMALL_CELL = 32
#: Most cells, a number each, that are broadcast to find their members.
MAX_BROADCAST = 500_000
#: Most ids of rows to leave out that are broadcast, so that no texts move.
MAX_GONE = 2_000_000


def fingerprint(text: Column, n_words: int = SHINGLE_WORDS, seed: int = SEED) -> Column:
    """Fingerprint (long) of a whole text, in Arrow batches; 0 for a null or blank text."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(x, n_words, seed) for x in texts), np.uint64, len(texts)).view(np.int64))

    return run(text.cast("string").cast("binary"))


def embedding(fp: Column) -> Column:
    """Bit counts (0, 1, 2) of the 32 segments of neighbouring bits, two bits each."""
    half = F.shiftrightunsigned(fp, 1)
    ones = fp.bitwiseXOR(half).bitwiseAND(F.lit(LOW))
    twos = F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(LOW)), 1)
    return ones.bitwiseOR(twos)


def crossed(fp: Column) -> Column:
    """``fp`` with the second and third bit of every four exchanged: its segments hold bits that are two apart."""
    inner = F.shiftrightunsigned(fp, 1).bitwiseXOR(fp).bitwiseAND(F.lit(0x2222222222222222))
    return fp.bitwiseXOR(inner).bitwiseXOR(F.shiftleft(inner, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings: segments whose xor is 10 differ by two, 01 and 11 by one."""
    d = a.bitwiseXOR(b)
    one = d.bitwiseAND(F.lit(LOW))
    two = F.shiftrightunsigned(d, 1).bitwiseAND(F.bitwise_not(d)).bitwiseAND(F.lit(LOW))
    return F.bit_count(one) + 2 * F.bit_count(two)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The four groups of every grid.
GRIDS = tuple(combinations(range(GROUPS), GROUPS - MAX_BITS))


def _bits(groups: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << 8 * g for g in groups))


def _cell(grid: Column, bits: Column, fp: Column) -> Column:
    """One number for the coordinates of a fingerprint on the axes of a grid. Cells that share a number by chance only add
    candidates."""
    return F.xxhash64(grid, embedding(fp).bitwiseAND(bits), embedding(crossed(fp)).bitwiseAND(bits))


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, grid, fp): every fingerprint in its cell of every grid."""
    grid = F.array(*(F.struct(F.lit(i).alias("grid"), F.lit(_bits(g)).alias("bits")) for i, g in enumerate(GRIDS)))
    placed = fps.select("fp", F.explode(grid).alias("g"))
    return placed.select(_cell(F.col("g.grid"), F.col("g.bits"), F.col("fp")).alias("cell"), F.col("g.grid").alias("grid"), "fp")


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return (manhattan(embedding(a), embedding(b)) <= max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def _met(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of cells with at least two fingerprints: edges (u, v) of those with two, and (cell, pivot) of the others."""
    met = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("pivot"), F.max("fp").alias("top")).where("n > 1")
    met = written(met, "simhash-met")
    twos = met.where((F.col("n") == 2) & _near(F.col("top"), F.col("pivot"), MAX_BITS)).select(F.col("top").alias("u"), F.col("pivot").alias("v"))
    return twos, met.where("n > 2").select("cell", "pivot", "n")


def _cut(open_cells: DataFrame) -> DataFrame:
    """(cell, side, fp, comp): the members of large cells in smaller ones, along the four groups that the grid leaves out.

    A cell for each group, of members that share it (side null: all are paired); and one of members whose groups' counts are
    all odd where the others' are all even, in which the two sides are paired.
    """
    left = F.element_at(F.array(*(F.array(*(F.lit(_bits((r,))) for r in range(GROUPS) if r not in g)) for g in GRIDS)), F.col("grid") + 1)
    shared = F.transform(F.col("left"), lambda bits: F.struct(_cell(F.col("cell"), bits, F.col("fp")).alias("cell"), F.lit(None).cast("int").alias("side")))
    odd = F.aggregate(F.col("left"), F.lit(0), lambda a, bits: a * 2 + F.bit_count(F.col("fp").bitwiseAND(bits)) % 2)
    side = odd >= 8
    apart = F.struct(F.xxhash64("cell", F.when(side, 15 - odd).otherwise(odd)).alias("cell"), side.cast("int").alias("side"))
    parts = F.explode(F.concat(shared, F.array(apart))).alias("p")
    return open_cells.withColumn("left", left).select(parts, "fp", "comp").select("p.cell", "p.side", "fp", "comp")


def _open(members: DataFrame) -> DataFrame | None:
    """The members (cell, fp, comp, ...) of cells that hold more than one component; with n, how many of them a cell has. None
    if there are none. ``members`` is a written table."""
    mixed = members.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a <> b")
    mixed = written(mixed.select("cell", "n", F.col("n").alias("rows")), "simhash-mixed")
    return joined(members, mixed, "cell", "rows", members.count()) if mixed.head(1) else None


def _pairs(cells: DataFrame) -> DataFrame:
    """Edges (u, v) of all linked members of one cell that are in different components, on different sides if there are sides."""
    a, b = cells.alias("a"), cells.alias("b")
    apart = F.coalesce(F.col("a.side") != F.col("b.side"), F.lit(True))
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.comp") != F.col("b.comp")) & apart & _near(F.col("a.fp"), F.col("b.fp"), MAX_BITS)
    return a.join(b, on).select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (column fp, distinct) linked at MAX_BITS differing bits or fewer.

    Not every linked pair has an edge: pairs that earlier edges already connect are left out. An edge may come twice.
    """
    n = fps.count()
    cells = _cells(fps.repartition(max(1, n // TASK)))
    twos, met = _met(cells)
    many = met.count()
    if not many:
        return twos.distinct()
    if many <= MAX_BROADCAST:
        shared = cells.join(F.broadcast(met.drop("n")), "cell")
    else:
        shared = joined(cells, met, "cell", "n", len(GRIDS) * n)
    shared = written(shared, "simhash-cells")
    stars = shared.where(F.col("fp") != F.col("pivot")).where(_near(F.col("fp"), F.col("pivot"), MAX_BITS)).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    stars = written(stars.unionByName(twos).distinct(), "simhash-stars")
    known = components(stars, "simhash-stars")
    members = shared.join(known.withColumnRenamed("node", "fp"), "fp", "left").select("cell", "grid", "fp", F.coalesce("component", "fp").alias("comp"))
    open_cells = _open(written(members, "simhash-members"))
    if open_cells is None:
        return stars
    open_cells = written(open_cells, "simhash-open")
    found = stars.unionByName(_pairs(open_cells.where(F.col("n") <= SMALL_CELL).select("cell", F.lit(None).cast("int").alias("side"), "fp", "comp")))
    large = open_cells.where(F.col("n") > SMALL_CELL)
    cut = _open(written(_cut(large), "simhash-cut")) if large.head(1) else None
    return found if cut is None else found.unionByName(_pairs(cut.drop("n")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fp long, component_id (least id reachable over links of MAX_BITS bits or fewer),
    component_fp long (least fingerprint of the component).

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows come back as often as they
    are in ``docs``; rows without an id share the component of their fingerprint. Other columns are not read. An empty
    table gives no rows.
    """
    ship(docs.sparkSession)
    own = written(spread(docs.select(id_col, text_col)).select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")), "simhash-fp")
    least = written(own.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "simhash-distinct")
    named = components(links(least.select("fp")), "simhash-components").withColumnRenamed("node", "fp")
    placed = least.join(named, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component_fp"))
    placed = written(placed, "simhash-placed")
    roots = placed.groupBy("component_fp").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    by_fp = written(joined(placed, roots, "component_fp", "members", placed.count()).select("fp", "component_id", "component_fp", "n"), "simhash-roots")
    return joined(own, by_fp, "fp", "n", own.count()).select(id_col, "fp", "component_id", "component_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of near-duplicates: the one with the least id.

    Rows that repeat an id are judged by their own texts; where several rows of one group have the kept id, one stays.
    Rows without an id stay. Columns keep their names and order, whatever they are called.
    """
    found = written(near_duplicates(docs, id_col, text_col), "simhash-groups")
    twice = written(found.groupBy(id_col).count().where("count > 1").select(id_col), "simhash-twice")
    gone = found.where(F.col(id_col) != F.col("component_id")).join(twice, id_col, "left_anti").select(id_col)
    out = written(twice.unionByName(gone), "simhash-gone")
    single = docs.join(F.broadcast(out) if out.count() <= MAX_GONE else out, id_col, "left_anti")
    again = docs.join(twice, id_col, "left_semi").select(F.struct("*").alias("row"), F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))
    kept = found.where(F.col(id_col) == F.col("component_id")).join(twice, id_col, "left_semi").select(F.col(id_col).alias("id"), "fp", "component_fp").distinct()
    return single.unionByName(again.join(kept, ["id", "fp"]).dropDuplicates(["id", "component_fp"]).select("row.*"))

"""Colour palettes by bin counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quant import index_bits


def grid_bits(cap: int) -> int:
    return 5 if cap <= 4096 else 6


def with_bin(points: DataFrame, g: int) -> DataFrame:
    top = {c: F.shiftright(F.col(c).cast("int"), 8 - g) for c in "rgb"}
    return points.withColumn("bin", top["r"].bitwiseOR(F.shiftleft(top["g"], g)).bitwiseOR(F.shiftleft(top["b"], 2 * g)))


def histogram(points: DataFrame, cap: int) -> DataFrame:
    """cloud_id, bin, count and channel sums."""
    binned = with_bin(points, grid_bits(cap))
    return binned.groupBy("cloud_id", "bin").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(f"sum_{c}") for c in "rgb"))


def entries(points: DataFrame, cap: int) -> DataFrame:
    """The palette: the fullest bins (ties: smaller bin), each by its rounded mean colour."""
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(F.desc("n"), "bin"))
    best = histogram(points, cap).withColumn("entry", rank - 1).where(F.col("entry") < max(cap, 1))
    return best.select("cloud_id", "entry", "bin", "n", *(F.expr(f"cast((sum_{c} + n div 2) div n as int)").alias(f"p{c}") for c in "rgb"))


def assign(points: DataFrame, cap: int) -> DataFrame:
    """Adds the entry of every point.

    A bin of the palette is its entry. Another bin is decided once, by its first point's colour: the nearest entry within two bins around,
    the closest shell first; without any, the entry whose colour is nearest to the bin's own centre. Bins are few (2^15 or 2^18 a cloud), so what
    is joined for them is small, whatever the number of points.
    """
    g = grid_bits(cap)
    palette, binned = entries(points, cap), with_bin(points, g)
    bins = binned.groupBy("cloud_id", "bin").agg(*(F.min_by(c, "idx").alias(c) for c in "rgb"))
    known = bins.join(palette.select("cloud_id", "bin", "entry"), ["cloud_id", "bin"], "left")
    hit = known.where("entry is not null").select("cloud_id", "bin", "entry")
    miss = known.where("entry is null").drop("entry")
    side = (1 << g) - 1
    own = {"x": F.col("bin").bitwiseAND(F.lit(side)), "y": F.shiftright("bin", g).bitwiseAND(F.lit(side)), "z": F.shiftright("bin", 2 * g)}
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)))
    around = miss.withColumns(own).select("*", F.posexplode(steps).alias("k", "s"))
    near = around.withColumns({"nx": F.col("x") + F.col("s.a"), "ny": F.col("y") + F.col("s.b"), "nz": F.col("z") + F.col("s.c")})
    inside = " and ".join(f"{c} between 0 and {side}" for c in ("nx", "ny", "nz"))
    near = near.where(inside).withColumn("near", F.col("nx").bitwiseOR(F.shiftleft("ny", g)).bitwiseOR(F.shiftleft("nz", 2 * g)))
    target = palette.select("cloud_id", F.col("bin").alias("near"), "entry", "pr", "pg", "pb")
    far = sum(((F.col(f"p{c}") - F.col(c).cast("int")) * (F.col(f"p{c}") - F.col(c).cast("int")) for c in "rgb"), F.lit(0))
    shell = F.greatest(F.abs(F.col("s.a")), F.abs(F.col("s.b")), F.abs(F.col("s.c")))
    found = near.join(target, ["cloud_id", "near"]).groupBy("cloud_id", "bin").agg(F.min_by("entry", F.struct(shell, far, F.col("k"))).alias("entry"))
    lost = miss.join(found, ["cloud_id", "bin"], "left_anti")
    half = 1 << (7 - g)
    off = sum(((F.col(f"p{c}") - F.shiftleft(F.col(a), 8 - g) - half) * (F.col(f"p{c}") - F.shiftleft(F.col(a), 8 - g) - half) for c, a in zip("rgb", "xyz", strict=True)), F.lit(0))
    # lost bins and palette entries are both bounded by the number of bins
    rest = lost.withColumns(own).join(palette.select("cloud_id", "entry", "pr", "pg", "pb"), "cloud_id").groupBy("cloud_id", "bin").agg(F.min_by("entry", F.struct(off, F.col("entry"))).alias("entry"))
    return binned.join(hit.unionByName(found).unionByName(rest), ["cloud_id", "bin"])


def estimate(points: DataFrame, position_bits: int, colour_bits: int, cap: int) -> DataFrame:
    """Bytes with and without a palette of the cap, and whether it is worth it (a margin of 256 bytes)."""
    n = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    index = index_bits(F.lit(cap))
    up = lambda bits: F.floor((bits + 7) / 8).cast("long")
    out = n.withColumns({"plain": up(F.col("n") * (3 * position_bits + 3 * colour_bits)), "indexed": up(F.col("n") * (3 * position_bits + index)) + 2 + 3 * cap})
    return out.withColumn("wins", F.col("indexed") + 256 < F.col("plain"))

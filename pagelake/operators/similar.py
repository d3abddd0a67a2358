"""Near-duplicate images by perceptual hash, exactly, by banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def halves(phash: Column) -> list[Column]:
    """A 64-bit hash in hex as two signed halves."""
    return [F.conv(F.substring(phash, i, 8), 16, 10).cast("long") for i in (1, 9)]


def near_hashes(hashes: DataFrame, column: str, radius: int = 5) -> DataFrame:
    """(a, b, distance): distinct 64-bit hex hashes at a Hamming distance of at most ``radius``, the less first.

    radius + 1 bands: two hashes within the radius agree in at least one band. Equal hashes are one row before the join, so
    copies are not expanded; hashes that are not 16 hex digits are left out.
    """
    h = hashes.where(F.lower(column).rlike("^[0-9a-f]{16}$")).select(F.lower(column).alias("h")).distinct()
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    bits = F.concat(*[F.lpad(F.bin(x), 32, "0") for x in halves(F.col("h"))])
    bands = F.array(*[F.struct(F.lit(i).alias("n"), F.substring(bits, a + 1, b - a).alias("v")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    x = h.select("h", *[c.alias(f"w{i}") for i, c in enumerate(halves(F.col("h")))], F.explode(bands).alias("band"))
    a, b = (x.select("band", F.col("h").alias(n), F.col("w0").alias(n + "0"), F.col("w1").alias(n + "1")) for n in "ab")
    distance = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    return a.join(b, "band").where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()

"""Faces turned so that neighbours agree on their sense, and closed parts outwards.

Two faces at an edge agree if they run along it in opposite senses. Each face stands on two sheets, as it
is and turned; a face's side on one sheet is linked to the side of its neighbour that agrees with it. The
connected components of the sheets tell which faces must be turned with regard to a part's least fid: those
whose unturned side lies on the other sheet. If both sides of a face are connected, no sense fits the
whole part, as on a Moebius strip.

Defined results: edges of three and more faces link nothing; a part that is closed (each edge of two faces)
is turned so that its volume is positive, the shell of a cavity too; an open part keeps the sense that
most of its faces have, of equal numbers that of its least fid; twisted parts stay as they are. Faces with a
repeated or null corner are parts of their own and stay. A turned face is v0, v2, v1; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orolith.operators import graph, mesh, solids
from orolith.operators.raster import JOB
from orolith.storage import sized, stored


def edge_pairs(faces: DataFrame, by: list[str]) -> DataFrame:
    """(job_id, f, g, same): the two faces of each edge that has two, f < g, and whether they run along it in the same sense."""
    sides = mesh.directed_edges(faces.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2"), by)
    side = F.struct("fid", (F.col("a") < F.col("b")).alias("up"))
    met = sides.groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"), F.min(side).alias("lo"), F.max(side).alias("hi"))
    return met.where("n = 2 AND lo.fid <> hi.fid").select(*by, F.col("lo.fid").alias("f"), F.col("hi.fid").alias("g"), (F.col("lo.up") == F.col("hi.up")).cast("long").alias("same"))


def sheets(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(job_id, fid, part, turn, twisted) of faces that have a neighbour; part is the least fid of it."""
    linked = pairs.select(*by, "f", "g", "same", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("s"))
    linked = linked.select(*by, (2 * F.col("f") + F.col("s")).alias("a"), (2 * F.col("g") + F.col("s").bitwiseXOR(F.col("same"))).alias("b"))
    roots = graph.banded(linked, by, 2 * mesh.BAND)
    first = F.pmod("node", F.lit(2)) == 0
    told = roots.groupBy(*by, F.floor(F.col("node") / 2).cast("long").alias("fid")).agg(F.min(F.when(first, F.col("root"))).alias("r0"), F.min(F.when(~first, F.col("root"))).alias("r1"))
    return told.select(*by, "fid", F.floor(F.least("r0", "r1") / 2).cast("long").alias("part"), (F.col("r0") > F.col("r1")).alias("turn"), (F.col("r0") == F.col("r1")).alias("twisted"))


def turned(faces: DataFrame, turn) -> DataFrame:
    return faces.withColumns({"v1": F.when(turn, F.col("v2")).otherwise(F.col("v1")), "v2": F.when(turn, F.col("v1")).otherwise(F.col("v2"))})


def wound(vertices: DataFrame, faces: DataFrame, by: list[str] = JOB) -> tuple[DataFrame, DataFrame]:
    """(faces in one sense, parts). parts is (job_id, part, n_faces, n_turned, closed, twisted)."""
    faces = stored(faces, "faces-to-wind")
    pairs = stored(edge_pairs(faces, by), "edge-pairs")
    keys = [*by, "fid"]
    placed = stored(sheets(pairs, by), "sheets")
    # Counted once for each edge at its smaller face: a part is closed if its faces have 3 / 2 edges each.
    own = pairs.groupBy(*by, F.col("f").alias("fid")).agg(F.count("*").alias("__edges"))
    out = faces.select(*keys, "v0", "v1", "v2").join(placed, keys, "left").join(own, keys, "left")
    out = out.withColumns({"part": F.coalesce("part", "fid"), "turn": F.coalesce("turn", F.lit(False)), "twisted": F.coalesce("twisted", F.lit(False)), "__edges": F.coalesce("__edges", F.lit(0))})
    out = stored(turned(out, F.col("turn")), "agreeing")
    group = [*by, "part"]
    met = mesh.corners(out, vertices, by=by)
    # volumes are seen from a corner of the part's first face; a part may be the whole mesh, so no side is gathered by part
    corner = out.where("fid = part").select(*group, F.col("v0").alias("vid")).join(vertices.select(*by, "vid", F.struct("x", "y", "z").alias("at")), [*by, "vid"]).drop("vid")
    here = [F.struct(*[(F.col(f"p{k}")[c] - F.coalesce(F.col("at")[c], F.lit(0.0))).alias(c) for c in "xyz"]).alias(f"p{k}") for k in range(3)]
    met = met.join(sized(stored(corner, "part-corners")), group, "left").select(*group, *here)
    n = mesh.cross(*[F.col(f"p{k}") for k in range(3)])
    volume = met.groupBy(*group).agg(F.sum(sum((F.col("p0")[c] * x for c, x in zip("xyz", n, strict=True)), F.lit(0.0))).alias("volume"))
    parts = out.groupBy(*group).agg(F.count("*").alias("n_faces"), F.count_if("turn").alias("n"), (2 * F.sum("__edges") == 3 * F.count("*")).alias("closed"), F.max("twisted").alias("twisted"))
    parts = parts.join(volume, group, "left").withColumn("back", F.when(F.col("closed"), F.coalesce(F.col("volume") < 0, F.lit(False))).otherwise(2 * F.col("n") > F.col("n_faces")))
    count = F.when(F.col("twisted"), F.lit(0)).when(F.col("back"), F.col("n_faces") - F.col("n")).otherwise(F.col("n"))
    parts = stored(parts.select(*group, "n_faces", count.alias("n_turned"), "closed", "twisted", "back"), "wound-parts")
    turn = out.select(*keys, "part", "turn").join(sized(parts.select(*group, "twisted", "back")), group).where(~F.col("twisted") & (F.col("turn") != F.col("back"))).select(*keys, F.lit(True).alias("__turn"))
    fixed = turned(faces.join(turn, keys, "left"), F.coalesce("__turn", F.lit(False))).select(faces.columns)
    return fixed, parts.drop("back")


def repaired(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A mesh cleaned, its faces in one sense, its holes filled and its closed parts turned outwards."""
    vertices, faces = mesh.clean(vertices, faces)
    vertices = stored(vertices, "clean-vertices")
    faces = solids.fill_holes(vertices, wound(vertices, faces)[0])
    return vertices, wound(vertices, faces)[0]

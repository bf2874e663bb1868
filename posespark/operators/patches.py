"""Body patches: rectangles along a skeleton, the affine map between those of two postures, and pixels drawn through it.

A patch is a row; its pixels are scan-lines of its corners. What meets is a pixel and the patches over it, in drawing order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import scan_lines

#: A patch spans a sixteenth of the joints, one joint at least.
SEGMENTS = 16


def body_patches(rows: DataFrame, skeleton: str, widths: Column, key: Sequence[str], head_on_top: bool = True, name: str = "") -> DataFrame:
    """key, place and the corners x0..x3, y0..y3 of each patch; place is the drawing order.

    The patches before the head and after the tail come first, so that they lie lowest, then those along the body, tail first, so that the
    head lies on top (or the other way round). A patch goes from a joint to the one a step further; its corners stand half its width to
    either side of both ends: start and end on the one side, end and start on the other. A patch between joints in one place has null
    corners. name is put before the corners' names.
    """
    body = rows.select(*key, F.col(skeleton).alias("_s"), widths.alias("_w"))
    body = body.withColumn("_step", F.greatest(F.lit(1), F.floor(F.size("_s") / SEGMENTS).cast("int"))).withColumn("_last", F.size("_s") - F.col("_step"))
    each = body.select("*", F.explode(F.sequence(F.lit(0), F.col("_last") + 1)).alias("place"))
    place, last, step = F.col("place"), F.col("_last"), F.col("_step")
    along = F.when(F.lit(head_on_top), last + 1 - place).otherwise(place - 2)
    start = F.when(place == 0, 0).when(place == 1, last - 1).otherwise(along)  # the joint that the patch starts from, or is laid out beyond
    joint = lambda i: F.element_at("_s", (i + 1).cast("int"))
    width = F.element_at("_w", (F.when(place == 1, last).otherwise(start) + 1).cast("int"))
    ends = each.select(*key, "place", joint(start).alias("p"), joint(start + step).alias("q"), width.alias("w"))
    beyond = lambda here, there: lambda c: 2 * F.col(f"{here}.{c}") - F.col(f"{there}.{c}")
    a = {c: F.when(place == 0, beyond("p", "q")(c)).when(place == 1, F.col(f"q.{c}")).otherwise(F.col(f"p.{c}")) for c in "xy"}
    b = {c: F.when(place == 0, F.col(f"p.{c}")).when(place == 1, beyond("q", "p")(c)).otherwise(F.col(f"q.{c}")) for c in "xy"}
    lines = ends.select(*key, "place", "w", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    lines = lines.withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")})
    lines = lines.withColumn("n", F.nullif(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.0)))
    lines = lines.withColumns({"px": -F.col("dy") / F.col("n") * (F.col("w") / 2), "py": F.col("dx") / F.col("n") * (F.col("w") / 2)})
    corners = {f"{name}{c}{k}": F.col(f"{e}{c}") + s * F.col(f"p{c}") for c in "xy" for k, (e, s) in enumerate((("a", 1), ("b", 1), ("b", -1), ("a", -1)))}
    return lines.select(*key, "place", *[v.alias(n) for n, v in corners.items()])


def patch_pixels(patches: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, place, y, x, and source_y and source_x: the nearest source pixel of each pixel of a patch.

    patches: key, place, corners x0.., y0.. of the patch that is drawn, and from_x0.., from_y0.. of the one that it is taken
    from. Both are rectangles, so the affine map between them goes along and across: shares of both sides are kept.
    """
    whole = patches.select(*key, "place", *[F.col(f"{c}{k}").cast("int").alias(f"{c}{k}") for c in "xy" for k in range(4)]).dropna()
    lines = scan_lines(whole, [*key, "place"])
    pixels = lines.select(*key, "place", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    met = pixels.join(patches, [*key, "place"])
    side = lambda a, b, n="": (F.col(f"{n}x{b}") - F.col(f"{n}x{a}"), F.col(f"{n}y{b}") - F.col(f"{n}y{a}"))
    (ux, uy), (vx, vy) = side(0, 1), side(1, 2)
    shares = met.withColumn("_s", ((F.col("x") - F.col("x0")) * ux + (F.col("y") - F.col("y0")) * uy) / F.nullif(ux * ux + uy * uy, F.lit(0.0)))
    shares = shares.withColumn("_t", ((F.col("x") - F.col("x0")) * vx + (F.col("y") - F.col("y0")) * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0)))
    (fx, fy), (gx, gy) = side(0, 1, "from_"), side(1, 2, "from_")
    near = lambda o, f, g: F.floor(F.col(f"from_{o}0") + F.col("_s") * f + F.col("_t") * g + 0.5).cast("int")
    return shares.select(*key, "place", "y", "x", near("y", fy, gy).alias("source_y"), near("x", fx, gx).alias("source_x"))


def draw_patches(pixels: DataFrame, source: DataFrame, key: Sequence[str], source_key: Sequence[str]) -> DataFrame:
    """key, y, x and value of the drawn body: patches laid over each other in order, each new value averaged with what is there.

    pixels: as patch_pixels() gives them, with the source_key of their image; source: source_key, y, x and value. Values of 0 and places outside
    the image draw nothing. A pixel gathers the few patches over it.
    """
    looked = source.select(*source_key, F.col("y").alias("source_y"), F.col("x").alias("source_x"), "value").filter("value > 0")
    met = pixels.join(looked, [*source_key, "source_y", "source_x"])
    over = met.groupBy(*key, "y", "x").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_v"))
    drawn = F.aggregate("_v", F.lit(0.0), lambda at, v: F.when(at > 0, (at + v["value"]) * 0.5).otherwise(v["value"].cast("double")))
    return over.select(*key, "y", "x", F.floor(drawn).cast("int").alias("value"))

"""Images as pixel tables: Otsu's level, connected blobs and the body's blob, by groups, windows over bins and joins.

A pixel is a row of the image's key, y, x and value. What is windowed is an image's histogram or one of its rows; what is joined
is runs of pixels, not pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import CENTRAL_MARGIN
from .lineage import cut

KEY = ("video", "frame_index")


def otsu_levels(pixels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key and level: the value that parts each image's pixels into two classes of greatest variance between them, the least of several.

    Pixels of value 0 are masked out and don't count. An image of one value has level 0. One aggregate
    counts values before they move; the windows run over at most 255 bins an image.
    """
    bins = pixels.filter("value > 0").groupBy(*key, "value").agg(F.count("*").alias("n"))
    along, whole = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    mass = F.col("n") * F.col("value")
    sums = bins.select(*key, "value", F.sum("n").over(along).alias("below"), F.sum(mass).over(along).alias("mass"), F.sum("n").over(whole).alias("all_n"), F.sum(mass).over(whole).alias("all_mass"))
    gap = F.col("all_mass").cast("double") * F.col("below") - F.col("mass").cast("double") * F.col("all_n")
    parted = F.col("below").cast("double") * (F.col("all_n") - F.col("below"))
    between = F.when(F.col("below") < F.col("all_n"), gap * gap / F.nullif(parted, F.lit(0.0))).otherwise(F.lit(-1.0))
    level = F.when(F.col("below") < F.col("all_n"), F.col("value")).otherwise(0)
    return sums.groupBy(*key).agg(F.max_by(level, F.struct(between, -F.col("value"))).alias("level"))


def dark_pixels(pixels: DataFrame, levels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Pixels below their image's level; those of value 0 never count."""
    return pixels.filter("value > 0").join(levels, list(key)).filter(F.col("value") < F.col("level")).drop("level")


def pixel_runs(foreground: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, y, x0 and x1 (the last pixel) of the maximal runs of each row of pixels."""
    row = Window.partitionBy(*key, "y").orderBy("x")
    marked = foreground.select(*key, "y", "x", (F.col("x") - F.row_number().over(row)).alias("island"))
    return marked.groupBy(*key, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def blobs(foreground: DataFrame, key: Sequence[str] = KEY, width: int = 1 << 16) -> DataFrame:
    """The runs of foreground pixels (key, y, x0, x1) with `blob`: the number y * width + x of the first pixel of their 8-connected blob.

    Runs of neighbouring rows that touch are linked once; then each run takes the least number among its neighbours', and the
    number of the run that this number names, until nothing changes. Each round is cut.
    """
    runs = cut(pixel_runs(foreground, key).withColumn("id", F.col("y") * width + F.col("x0")))
    below = runs.select(*key, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("other"))
    links = runs.join(below, [*key, "y"]).filter((F.col("x0") <= F.col("b1") + 1) & (F.col("b0") <= F.col("x1") + 1))
    both = F.explode(F.array(F.struct(F.col("id").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("id").alias("b")))).alias("l")
    links = cut(links.select(*key, both).select(*key, "l.a", "l.b"))
    names = cut(runs.select(*key, "id", F.col("id").alias("blob")))
    while True:
        least = links.join(names.withColumnRenamed("id", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("id")).agg(F.min("blob").alias("near"))
        after = names.join(least, [*key, "id"], "left").select(*key, "id", F.col("blob").alias("old"), F.least("blob", "near").alias("blob"))
        roots = after.select(*key, F.col("id").alias("blob"), F.col("blob").alias("root"))
        after = cut(after.join(roots, [*key, "blob"]).select(*key, "id", F.col("root").alias("blob"), (F.col("root") != F.col("old")).alias("moved")))
        names = after.drop("moved")
        if after.filter("moved").isEmpty():
            return runs.join(names, [*key, "id"]).drop("id")


def central_blob(foreground: DataFrame, sizes: DataFrame, key: Sequence[str] = KEY, margin: float = CENTRAL_MARGIN) -> DataFrame:
    """key, blob, n_pixels, n_central and the box (y0, y1, x0, x1, ends left out) of the blob with most pixels in the middle of its image.

    sizes: key, height and width. The middle leaves out a share of the longer side at each edge; of equal blobs the first counts. Images without
    foreground have no row.
    """
    met = blobs(foreground, key).join(sizes, list(key))
    edge = F.floor(margin * F.greatest("height", "width"))
    inner = F.greatest(F.lit(0), F.least(F.col("x1"), F.col("width") - edge - 1) - F.greatest(F.col("x0"), edge) + 1)
    inner = F.when((F.col("y") >= edge) & (F.col("y") < F.col("height") - edge), inner).otherwise(0)
    found = met.groupBy(*key, "blob").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("n_pixels"), F.sum(inner).alias("n_central"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
    )
    row = F.struct("blob", "n_pixels", "n_central", "y0", "y1", "x0", "x1")
    return found.groupBy(*key).agg(F.max_by(row, F.struct("n_central", -F.col("blob"))).alias("b")).select(*key, "b.*")


def outline_spans(rows: DataFrame, skeleton: str, half_widths: Column, key: Sequence[str]) -> DataFrame:
    """key, y, x0 and x1 (the last pixel) of the scan-lines of a body drawn as quads along its skeleton and discs at its ends.

    A quad's sides stand across the line from the joint before last to the joint, at half the width on either side; it shares
    two corners with the quad before it. Corners, centres and radii are cut to whole numbers; a scan-line goes from the least to
    the greatest crossing with the sides, rounded. Spans may overlap. Quads with a missing corner (joints in one place) are left out.
    """
    body = rows.select(*key, F.col(skeleton).alias("_s"), half_widths.alias("_h"))
    joints = body.select(*key, "_s", "_h", F.explode(F.sequence(F.lit(1), F.size("_s") - 1)).alias("_i")).filter(F.size("_s") > 2)
    # side 1 stands at the first joint, across the line to joint 2
    to, at = F.greatest("_i", F.lit(2)), F.when(F.col("_i") == 1, 0).otherwise(F.col("_i"))
    joint = lambda i: F.element_at("_s", (i + 1).cast("int"))
    lines = joints.select(*key, "_i", joint(to).alias("p"), joint(to - 2).alias("q"), joint(at).alias("c"), F.element_at("_h", F.col("_i") + 1).alias("w"))
    lines = lines.select(*key, "_i", (F.col("p.x") - F.col("q.x")).alias("dx"), (F.col("p.y") - F.col("q.y")).alias("dy"), "c", "w")
    lines = lines.withColumn("length", F.nullif(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.0)))
    ox, oy = F.col("dy") / F.col("length") * F.col("w"), -F.col("dx") / F.col("length") * F.col("w")
    corner = {f"{n}{axis}": (F.col(f"c.{axis}") + s * o).cast("int") for n, s in (("a", 1), ("b", -1)) for axis, o in (("x", ox), ("y", oy))}
    sides = lines.select(*key, "_i", *[v.alias(n) for n, v in corner.items()])
    along = Window.partitionBy(*key).orderBy("_i")  # the joints of one body
    quads = sides.select(*key, "_i", *corner, *[F.lag(n).over(along).alias(f"{n}_") for n in corner]).filter("_i >= 2").dropna(subset=[*corner, *[f"{n}_" for n in corner]])
    spans = scan_lines(quads.select(*key, *_corners(["ax", "bx", "bx_", "ax_"], ["ay", "by", "by_", "ay_"])), key)
    ends = body.select(*key, F.explode(F.array(*[F.struct(F.element_at("_s", k)["x"].cast("int").alias("x"), F.element_at("_s", k)["y"].cast("int").alias("y"), F.element_at("_h", k).cast("int").alias("r")) for k in (1, -1)])).alias("c"))
    discs = ends.filter("c.x is not null and c.y is not null and c.r is not null").select(*key, "c.*").withColumn("d", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    reach = F.floor(F.sqrt(F.col("r") * F.col("r") - F.col("d") * F.col("d"))).cast("int")
    return spans.unionByName(discs.select(*key, (F.col("y") + F.col("d")).alias("y"), (F.col("x") - reach).alias("x0"), (F.col("x") + reach).alias("x1")))


def _corners(xs: Sequence[str], ys: Sequence[str]) -> list[Column]:
    return [F.col(n).alias(f"{axis}{k}") for axis, names in (("x", xs), ("y", ys)) for k, n in enumerate(names)]


def scan_lines(quads: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, y, x0 and x1 (the last pixel) of the rows of pixels of convex quads with corners x0..x3, y0..y3 in whole numbers."""
    ys = [F.col(f"y{k}") for k in range(4)]
    named = quads.select(*key, *[F.col(f"{a}{k}").alias(f"_{a}{k}") for a in "xy" for k in range(4)], F.explode(F.sequence(F.least(*ys), F.greatest(*ys))).alias("y"))
    crossing = []
    for k in range(4):
        (ax, ay), (bx, by) = ((F.col(f"_x{j}"), F.col(f"_y{j}")) for j in (k, (k + 1) % 4))
        flat, met = ay == by, (F.col("y") >= F.least(ay, by)) & (F.col("y") <= F.greatest(ay, by))
        crossing += [F.when(met, F.when(flat, ax).otherwise(ax + (bx - ax) * (F.col("y") - ay) / F.nullif(by - ay, F.lit(0))).cast("double")), F.when(met & flat, bx.cast("double"))]
    return named.select(*key, "y", *[F.floor(f(*crossing) + 0.5).cast("int").alias(n) for n, f in (("x0", F.least), ("x1", F.greatest))])


def span_area(spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """key and n_pixels, each pixel counted once: on a row a span adds what lies beyond the spans before it."""
    row = Window.partitionBy(*key, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("x1").over(row), F.col("x0") - 1)
    added = spans.withColumn("_added", F.greatest(F.lit(0), F.col("x1") - F.greatest(seen, F.col("x0") - 1)))
    return added.groupBy(*key).agg(F.sum("_added").alias("n_pixels"))

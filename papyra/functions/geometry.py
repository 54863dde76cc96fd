"""Page geometry and affine matrices [a, b, c, d, e, f]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.lookup import look_up


def points(x: Column) -> Column:
    """A length to a tenth of a point, without a trailing .0."""
    return F.regexp_replace(F.round(x, 1).cast("decimal(18,1)").cast("string"), r"\.0$", "")


def paper_key(width: Column, height: Column) -> Column:
    return F.concat(points(F.least(width, height)), F.lit("x"), points(F.greatest(width, height)))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width >= height, "landscape").otherwise("portrait")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def matrix_multiply(m: Column, n: Column) -> Column:
    a, b, c, d, e, f = (m[i] for i in range(6))
    g, h, i, j, k, l = (n[x] for x in range(6))  # noqa: E741
    return F.array(a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def parallelogram_area(m: Column) -> Column:
    return F.abs(m[0] * m[3] - m[1] * m[2])


def bbox(m: Column) -> Column:
    """Axis-aligned box of the transformed unit square."""
    xs = [m[4], m[4] + m[0], m[4] + m[2], m[4] + m[0] + m[2]]
    ys = [m[5], m[5] + m[1], m[5] + m[3], m[5] + m[1] + m[3]]
    return F.struct(F.least(*xs).alias("min_x"), F.least(*ys).alias("min_y"), F.greatest(*xs).alias("max_x"), F.greatest(*ys).alias("max_y"))


def image_coverage(ops: Column, page_area: Column) -> Column:
    """Fold of a page's drawing operations (array of struct op, matrix): max and total coverage, large images.

    op is save, restore, transform, set or paint. The graphics state is a stack of matrices; the
    maximum is over all images, total and count only over those that cover enough of the page.
    """
    identity = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    start = F.struct(identity.alias("ctm"), F.array().cast("array<array<double>>").alias("stack"), F.lit(0.0).alias("max"), F.lit(0.0).alias("total"), F.lit(0).alias("large"))
    area = F.greatest(F.lit(1.0), page_area)

    def step(s: Column, x: Column) -> Column:
        ratio = clamp01(parallelogram_area(s["ctm"]) / area)
        paint, counted = x["op"] == "paint", (x["op"] == "paint") & (ratio >= fixed.COUNTED_COVERAGE)
        ctm = (
            F.when(x["op"] == "restore", F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), identity))
            .when(x["op"] == "transform", matrix_multiply(s["ctm"], x["matrix"]))
            .when(x["op"] == "set", x["matrix"])
            .otherwise(s["ctm"])
        )
        stack = F.when(x["op"] == "save", F.array_append(s["stack"], s["ctm"])).when(x["op"] == "restore", F.slice(s["stack"], F.lit(1), F.greatest(F.lit(0), F.size(s["stack"]) - 1))).otherwise(s["stack"])
        return F.struct(
            ctm.alias("ctm"),
            stack.alias("stack"),
            F.when(paint, F.greatest(s["max"], ratio)).otherwise(s["max"]).alias("max"),
            F.when(counted, s["total"] + parallelogram_area(s["ctm"])).otherwise(s["total"]).alias("total"),
            F.when(counted, s["large"] + 1).otherwise(s["large"]).alias("large"),
        )

    return F.aggregate(ops, start, step, lambda s: F.struct(s["max"].alias("max_coverage"), clamp01(s["total"] / area).alias("total_coverage"), s["large"].alias("large_images")))


def adaptive_scale(kind: Column, width: Column, height: Column, cap: int | None = None, most: float = 3.0) -> Column:
    edge = F.coalesce(look_up({k: str(v) for k, v in fixed.LONG_EDGE.items()}, kind).cast("double"), F.lit(float(fixed.LONG_EDGE["unknown"])))
    if cap is not None:
        edge = F.least(edge, F.lit(float(cap)))
    return F.least(edge / F.greatest(width, height), F.lit(most))


def resize_dims(width: Column, height: Column, max_dimension: int = 2048) -> Column:
    """Size that fits into the square of the limit; nothing is enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(min(max_dimension, 2048))) / F.greatest(width, height))
    return F.struct(F.floor(width * scale + 0.5).cast("int").alias("width"), F.floor(height * scale + 0.5).cast("int").alias("height"))

"""Operators on grids: an array column that holds h x w cells row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return total(a) / F.size(a)


def std_of(a: Column) -> Column:
    """Population deviation."""
    m = F.array(mean_of(a))
    return F.transform(m, lambda c: F.sqrt(total(F.transform(a, lambda x: (x - c) * (x - c))) / F.size(a)))[0]


def edge_density(a: Column, w: int) -> Column:
    """mean |dx| + mean |dy| of a grid w wide."""
    dx = F.filter(F.transform(a, lambda x, p: F.when(p % w != 0, F.abs(x - F.get(a, p - 1)))), lambda x: x.isNotNull())
    dy = F.filter(F.transform(a, lambda x, p: F.when(p >= w, F.abs(x - F.get(a, p - w)))), lambda x: x.isNotNull())
    return mean_of(dx) + mean_of(dy)


def histogram(a: Column, bins: int) -> Column:
    """Density over `bins` equal bins of [0, 1]; the last holds 1."""
    at = lambda x: F.least(F.lit(bins - 1), F.floor(x * bins))
    hits = F.transform(a, at)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(hits, lambda h: h == b)) * float(bins) / F.size(a))


def letterbox(w: Column, h: Column, size: int) -> dict[str, Column]:
    """Geometry of fitting w x h into a square: half-even rounded sides, the smaller half of the padding left and top."""
    s = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    rw, rh = F.bround(w * s).cast("int"), F.bround(h * s).cast("int")
    left, top = F.floor((size - rw) / 2).cast("int"), F.floor((size - rh) / 2).cast("int")
    return {"scale": s, "resized_w": rw, "resized_h": rh, "pad_left": left, "pad_right": size - rw - left, "pad_top": top, "pad_bottom": size - rh - top}


def _block(pos: Column, side: int, g: int) -> Column:
    """The block of a row or column; the last one takes the rest."""
    return F.least(F.lit(g - 1), F.floor(pos / side)).cast("int")


def _inner_edges(a: Column, w: int, h: int, g: int) -> tuple[Column, Column]:
    """|difference to the left| and |difference to the cell above| by cell, null across blocks. Arrays, so that no cell carries its grid along."""

    def left(x: Column, p: Column) -> Column:
        c = p % w
        return F.when((c > 0) & (_block(c - 1, w // g, g) == _block(c, w // g, g)), F.abs(x - F.get(a, p - 1)))

    def above(x: Column, p: Column) -> Column:
        r = F.floor(p / w)
        return F.when((r > 0) & (_block(r - 1, h // g, g) == _block(r, h // g, g)), F.abs(x - F.get(a, (p - w).cast("int"))))

    return F.transform(a, left), F.transform(a, above)


def _edge() -> Column:
    return F.coalesce(F.avg("dx"), F.lit(0.0)) + F.coalesce(F.avg("dy"), F.lit(0.0))


def block_statistics(df: DataFrame, column: str, w: int, g: int) -> DataFrame:
    """Rows (item_id, block, mean, std, edge) of g x g blocks of a w x w grid; the last row and column take the rest. Edges are inside blocks."""
    dx, dy = _inner_edges(F.col(column), w, w, g)
    d = df.select("item_id", F.posexplode(F.arrays_zip(F.col(column).alias("x"), dx.alias("dx"), dy.alias("dy"))).alias("pos", "c")).select("item_id", "pos", "c.*")
    d = d.withColumn("block", _block(F.floor(F.col("pos") / w), w // g, g) * g + _block(F.col("pos") % w, w // g, g))
    return d.groupBy("item_id", "block").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), _edge().alias("edge"))


#: Weights of red, green and blue in gray (fixed values).
GRAY = (0.299, 0.587, 0.114)


def patch_features(df: DataFrame, channels: list[str], w: int, h: int, g: int, xy: bool = False) -> DataFrame:
    """Rows (item_id, i, j, features) of the g x g blocks of items with three w x h channels in [0, 1], row by row: the channels' means, their
    population deviations, the edge density of the gray block, and with xy the block's place from 0 to 1. The last row and column take the rest.
    """
    gray = F.transform(F.arrays_zip(*channels), lambda c: sum((c[n] * k for n, k in zip(channels, GRAY, strict=True)), F.lit(0.0)))
    dx, dy = _inner_edges(F.col("_gray"), w, h, g)
    cells = F.arrays_zip(*channels, dx.alias("dx"), dy.alias("dy"))
    d = df.withColumn("_gray", gray).select("item_id", F.posexplode(cells).alias("pos", "c")).select("item_id", "pos", "c.*")
    d = d.withColumns({"i": _block(F.floor(F.col("pos") / w), h // g, g), "j": _block(F.col("pos") % w, w // g, g)})
    f = F.array(*[F.avg(c) for c in channels], *[F.stddev_pop(c) for c in channels], _edge())
    d = d.groupBy("item_id", "i", "j").agg(f.alias("features"))
    place = [F.col(c) / float(max(1, g - 1)) for c in ("i", "j")]
    return d.withColumn("features", F.concat("features", F.array(*place))) if xy else d


def position_moments(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean and variance (n) of each grid position across items."""
    return df.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def local_contrast(a: Column) -> Column:
    """|x - mean of the grid| by cell."""
    return F.transform(F.array(mean_of(a)), lambda m: F.transform(a, lambda x: F.abs(x - m)))[0]


def upsampled(scores: Column, g: int, box: tuple[int, int, int, int], size: int) -> Column:
    """A g x g score grid drawn bilinearly (half-pixel centres, clamped edges) into box (left, top, right, bottom) of a size x size canvas, zero outside."""
    left, top, right, bottom = box

    def at(p: Column, lo: int, hi: int) -> Column:
        return F.least(F.lit(g - 1.0), F.greatest(F.lit(0.0), (p - lo + 0.5) * g / float(hi - lo) - 0.5))

    def cell(p: Column) -> Column:
        y, x = F.floor(p / size), p % size
        fy, fx = at(y, top, bottom), at(x, left, right)
        y0, x0 = F.floor(fy), F.floor(fx)
        y1, x1 = F.least(y0 + 1, F.lit(g - 1)), F.least(x0 + 1, F.lit(g - 1))
        v = lambda a, b: F.get(scores, (a * g + b).cast("int"))
        ty, tx = fy - y0, fx - x0
        inside = (x >= left) & (x < right) & (y >= top) & (y < bottom)
        value = (v(y0, x0) * (1 - tx) + v(y0, x1) * tx) * (1 - ty) + (v(y1, x0) * (1 - tx) + v(y1, x1) * tx) * ty
        return F.when(inside, value).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), cell)


def overlay(image: Column, mask: Column, alpha: float = 0.4) -> Column:
    """Cells of an image under a mask blended towards 1, clipped to [0, 1]."""
    return F.zip_with(image, mask, lambda v, m: F.when(m > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - alpha) * v + alpha))).otherwise(v))

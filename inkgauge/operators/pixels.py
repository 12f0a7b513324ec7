"""Metrics on the pixel relation (image_id, x, y, g), as plain aggregates and windows.

This is the form that SQL can check; the kernels are the form for production.
Sums are of integers, so they don't depend on order. Windows partition by image
and row or column, never by a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = "image_id"


def text_rasters(documents: DataFrame, width: int = 128) -> DataFrame:
    """Pixels of byte rasters: the UTF-8 bytes of each text laid out in full rows of ``width``.

    A byte up to 32 is paper (240), another is 2 * (byte % 64). An incomplete
    last row is dropped, so a raster is rectangular; null and short texts have
    no pixels.
    """
    # Read as Latin-1 a byte is a character, and splitting on nothing is a fast path; positions come from posexplode.
    # The texts are hashed by image once, before they become 20 times as large as pixels; all groupings and windows by image then need no shuffle.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents = documents.select(F.col("doc_id").alias(ID), "text").repartition(tasks, ID)
    byte = F.posexplode(F.split(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "")).alias("pos", "c")
    p = documents.select(ID, F.octet_length("text").alias("n"), byte)
    b = F.ascii("c")
    return p.filter(F.col("pos") < F.expr(f"n div {width} * {width}")).select(ID, (F.col("pos") % width).alias("x"), F.expr(f"pos div {width}").cast("int").alias("y"), F.when(b <= 32, 240).otherwise(2 * (b % 64)).cast("int").alias("g"))


def vector_rasters(embeddings: DataFrame, rows: int = 64) -> DataFrame:
    """Rasters of ``rows`` vectors each, by vec_id: a row per vector, a pixel per element."""
    v = embeddings.select(F.expr(f"vec_id div {rows}").alias(ID), F.expr(f"cast(vec_id % {rows} as int)").alias("y"), F.posexplode("embedding").alias("x", "v"))
    g = F.floor((F.col("v").cast("double") + 0.55) * 230)
    return v.select(ID, "x", "y", F.greatest(F.lit(0), F.least(F.lit(255), g)).cast("int").alias("g"))


def sizes(px: DataFrame) -> DataFrame:
    return px.groupBy(ID).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def with_sizes(px: DataFrame) -> DataFrame:
    return px.join(sizes(px), ID)


def channel_stats(px: DataFrame) -> DataFrame:
    """(image_id, n, mean, stdev): sample standard deviation."""
    s, q, n = F.sum("g"), F.sum(F.col("g") * F.col("g")), F.count(F.lit(1))
    return px.groupBy(ID).agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / F.nullif(n - 1, F.lit(0)))).alias("stdev"))


def foreground(px: DataFrame, below: int = 128) -> DataFrame:
    return px.groupBy(ID).agg((F.count_if(F.col("g") < below) / F.count(F.lit(1))).alias("foreground"))


def histogram_p90(px: DataFrame) -> DataFrame:
    """Least grey level with floor(0.9 n) pixels at or below; by histogram, not by sorting pixels."""
    hist = px.groupBy(ID, "g").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy(ID)
    upto = F.sum("c").over(by.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    return hist.select(ID, "g", upto.alias("upto"), F.sum("c").over(by).alias("n")).filter(F.col("upto") >= F.floor(F.col("n") * 0.9)).groupBy(ID).agg(F.min("g").alias("p90"))


def laplacian(px: DataFrame) -> DataFrame:
    """(image_id, x, y, v) of inner pixels: 9 g - the 3 x 3 sum, in 0..255, by row and column windows."""
    row, col = Window.partitionBy(ID, "y").orderBy("x"), Window.partitionBy(ID, "x").orderBy("y")
    a = px.select(ID, "x", "y", "g", (F.col("g") + F.lag("g").over(row) + F.lead("g").over(row)).alias("three"))
    b = a.select(ID, "x", "y", "g", (F.col("three") + F.lag("three").over(col) + F.lead("three").over(col)).alias("nine"))
    return b.filter("nine is not null").select(ID, "x", "y", F.greatest(F.lit(0), F.least(F.lit(255), 9 * F.col("g") - F.col("nine"))).alias("v"))


def laplacian_stats(px: DataFrame, edge: int = 30) -> DataFrame:
    s, q, n = F.sum("v"), F.sum(F.col("v") * F.col("v")), F.count(F.lit(1))
    return laplacian(px).groupBy(ID).agg((s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))).alias("stdev"), (F.count_if(F.col("v") > edge) / n).alias("edge_ratio"))


def half_split(px: DataFrame) -> DataFrame:
    """(image_id, top, bottom, diff, ratio): means and variances of the upper and lower half."""
    p = with_sizes(px).filter("h > 20").withColumn("up", F.expr("y < h div 2"))
    g, g2 = F.col("g"), F.col("g") * F.col("g")
    mean = lambda c: F.avg(F.when(c, g))
    spread = lambda c: F.avg(F.when(c, g2)) - F.avg(F.when(c, g)) * F.avg(F.when(c, g))
    up, down = F.col("up"), ~F.col("up")
    out = p.groupBy(ID).agg(mean(up).alias("top"), mean(down).alias("bottom"), spread(up).alias("vt"), spread(down).alias("vb"))
    low, high = F.least("vt", "vb"), F.greatest("vt", "vb")
    return out.select(ID, "top", "bottom", F.abs(F.col("top") - F.col("bottom")).alias("diff"), F.when(low > 5, high / low).alias("ratio"))


def edge_centre(px: DataFrame) -> DataFrame:
    """(image_id, edge, centre, diff) of images of 20 x 20 and more."""
    p = with_sizes(px).filter("h >= 20 and w >= 20").withColumn("s", F.expr("greatest(1, cast(floor(least(w, h) * 0.1D) as int))"))
    edge = F.expr("y < s or y >= h - s or x < s or x >= w - s")
    centre = F.expr("x >= floor(w * 0.3D) and x < floor(w * 0.7D) and y >= floor(h * 0.3D) and y < floor(h * 0.7D)")
    out = p.groupBy(ID).agg(F.avg(F.when(edge, F.col("g"))).alias("edge"), F.avg(F.when(centre, F.col("g"))).alias("centre"))
    return out.filter("centre is not null").withColumn("diff", F.col("centre") - F.col("edge"))


def zones(px: DataFrame) -> DataFrame:
    """(image_id, z0..z3, spread): quadrant means of images of 100 rows and columns and more."""
    p = with_sizes(px).filter("h >= 100 and w >= 100").withColumn("z", F.expr("if(y < h div 2, 0, 2) + if(x < w div 2, 0, 1)"))
    out = p.groupBy(ID).agg(*[F.avg(F.when(F.col("z") == i, F.col("g"))).alias(f"z{i}") for i in range(4)])
    z = [F.col(f"z{i}") for i in range(4)]
    return out.withColumn("spread", F.greatest(*z) - F.least(*z))


def blockiness(px: DataFrame) -> DataFrame:
    """(image_id, blockiness): steps on the 8-pixel grid against all others."""
    p = with_sizes(px).filter("h >= 16 and w >= 16")
    dx = F.abs(F.col("g") - F.lag("g").over(Window.partitionBy(ID, "y").orderBy("x")))
    dy = F.abs(F.col("g") - F.lag("g").over(Window.partitionBy(ID, "x").orderBy("y")))
    steps = p.select(ID, "x", "y", dx.alias("dx"), dy.alias("dy"))
    part = lambda on, d, k: F.sum(F.when((F.col(k) % 8 == 0) if on else (F.col(k) % 8 != 0), F.col(d)))
    count = lambda on, d, k: F.count(F.when((F.col(k) % 8 == 0) if on else (F.col(k) % 8 != 0), F.col(d)))
    total = lambda f, on: f(on, "dx", "x") + f(on, "dy", "y")
    by = steps.groupBy(ID).agg((total(part, True) / F.nullif(total(count, True), F.lit(0))).alias("a"), (total(part, False) / F.nullif(total(count, False), F.lit(0))).alias("b"))
    return by.select(ID, F.when(F.col("b") < 0.1, F.when(F.col("a") > 0.5, 10.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("a") / F.col("b") - 1)).alias("blockiness"))


def skew(px: DataFrame, value: str = "v", edge: int = 30) -> DataFrame:
    """(image_id, angle) of edge pixels (image_id, x, y, v): a line through the strips' centres of mass."""
    p = px.join(sizes(px), ID).filter("h >= 20 and w >= 20").withColumn("sw", F.expr("w div 20")).withColumn("strip", F.expr("x div sw")).filter(f"strip < 20 and {value} > {edge}")
    strips = p.groupBy(ID, "strip").agg(F.first("sw").alias("sw"), (F.sum(F.col("y") * F.col(value)) / F.sum(value)).alias("cy")).withColumn("cx", F.col("strip") * F.col("sw") + F.col("sw") / 2)
    line = strips.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("cy", "cx").alias("slope"))
    return line.filter("n >= 3 and slope is not null").select(ID, F.degrees(F.abs(F.atan("slope"))).alias("angle"))


def row_clusters(points: DataFrame, gap: Column, by: str = ID, y: str = "cy") -> DataFrame:
    """Gaps and islands: points sorted by ``y``, a new row where the step exceeds ``gap``."""
    w = Window.partitionBy(by).orderBy(y, "label")
    new = F.when(F.col(y) - F.lag(y).over(w) > gap, 1).otherwise(0)
    return points.withColumn("_new", new).withColumn("row_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def baseline_deviation(rows: DataFrame, by: str = ID) -> DataFrame:
    """Mean over rows of 5 and more points of the root mean square residual of their line."""
    r = rows.groupBy(by, "row_no").agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("cy", "cx").alias("sxx"), F.regr_syy("cy", "cx").alias("syy"), F.regr_sxy("cy", "cx").alias("sxy"))
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return r.filter("n >= 5 and sxx * n > 1e-10").groupBy(by).agg(F.avg(F.sqrt(left / F.col("n"))).alias("residual"), F.count(F.lit(1)).alias("lines"))


def runs(px: DataFrame, dark_below: int = 128) -> DataFrame:
    """Horizontal runs of dark pixels: (image_id, y, x0, x1, cx, cy, area, label)."""
    dark = px.filter(F.col("g") < dark_below)
    island = F.col("x") - F.row_number().over(Window.partitionBy(ID, "y").orderBy("x"))
    r = dark.withColumn("_i", island).groupBy(ID, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("area")).drop("_i")
    return r.select(ID, "y", "x0", "x1", "area", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), F.col("y").cast("double").alias("cy"), (F.col("y") * 100000 + F.col("x0")).alias("label"))


def smoothed(px: DataFrame) -> DataFrame:
    """Running mean of three along each row, ends unchanged."""
    w = Window.partitionBy(ID, "y").orderBy("x")
    mid = (F.lag("g").over(w) + F.col("g") + F.lead("g").over(w)) / 3
    return px.select(ID, "x", "y", F.coalesce(mid, F.col("g").cast("double")).alias("s"))


def first_rise(px: DataFrame) -> DataFrame:
    """(image_id, y, x): the first rise from dark to bright along each row, if any."""
    w = Window.partitionBy(ID, "y").orderBy("x")
    s = smoothed(px).select(ID, "y", "x", "s", F.min("s").over(w.rowsBetween(-3, -1)).alias("low"), F.lag("s", 3).over(w).alias("back"))
    return s.filter("s >= 160 and low < 120 and s - back >= 25").groupBy(ID, "y").agg(F.min("x").alias("x"))


def area_average(px: DataFrame, side: int) -> DataFrame:
    """Downsample to at most ``side`` by fractional overlap, as a join of each pixel with the cells it covers."""
    p = with_sizes(px).withColumn("k", F.least(F.lit(1.0), side / F.greatest("w", "h")))
    p = p.withColumn("nw", F.greatest(F.lit(1), F.floor(F.col("w") * F.col("k") + 0.5).cast("int"))).withColumn("nh", F.greatest(F.lit(1), F.floor(F.col("h") * F.col("k") + 0.5).cast("int")))

    def cover(a: str, n: str, m: str) -> Column:
        step = F.col(n) / F.col(m)
        first, last = F.floor(F.col(a) / step).cast("int"), F.least(F.col(m) - 1, F.ceil((F.col(a) + 1) / step).cast("int") - 1)
        return F.transform(F.sequence(F.least(first, last), last), lambda c: F.struct(c.alias("at"), (F.least(F.col(a) + 1.0, (c + 1) * step) - F.greatest(F.col(a) + 0.0, c * step)).alias("wt")))

    p = p.withColumn("cx", F.explode(cover("x", "w", "nw"))).withColumn("cy", F.explode(cover("y", "h", "nh")))
    wt = F.col("cx.wt") * F.col("cy.wt")
    return p.groupBy(ID, F.col("cx.at").alias("x"), F.col("cy.at").alias("y")).agg((F.sum(F.col("g") * wt) / F.sum(wt)).alias("g"))

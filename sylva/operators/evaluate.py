"""Accuracy: sweeps, buffer scores, mask scores, point scores, dice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.geometry import distance, pin
from sylva.operators.compare import compare_detections
from sylva.operators.edges import crossed_cells
from sylva.operators.mission import resample_line
from sylva.operators.spatial import explode_around, nearest_within
from sylva.session import materialize, meet


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores(df: DataFrame) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def threshold_sweep(samples: DataFrame, thresholds: list[float], positive: str, value: str = "exg") -> DataFrame:
    """Per threshold: a sample below it is called positive. One pass: samples are
    counted per value first, so the sweep multiplies distinct values, not rows."""
    truth = F.col("cls") == positive
    per_value = samples.groupBy(value).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    swept = per_value.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    called = F.col(value) < F.col("threshold")
    counts = swept.groupBy("threshold").agg(
        F.sum(F.when(called, F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(called, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~called, F.col("p")).otherwise(0)).alias("fn"))
    return _scores(counts)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The highest F1, the lowest threshold on a tie."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def buffer_score(found: DataFrame, truth: DataFrame, d: float, step: float) -> DataFrame:
    """Share of each network within d of the other, measured on points every
    ``step`` along both (``fid, path``)."""
    def points(lines: DataFrame) -> DataFrame:
        return materialize(resample_line(lines, step).select(F.struct("fid", "k").alias("fid"), "x", "y"))
    a, b = points(found), points(truth)
    def share(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        near = nearest_within(p, q, d, inclusive=True)
        hit = near.agg(F.count("*").alias(f"{name}_near")).withColumn("_one", F.lit(1))
        return p.agg(F.count("*").alias(f"{name}_all")).withColumn("_one", F.lit(1)).join(hit, "_one")
    both = share(a, b, "found").join(share(b, a, "truth"), "_one").drop("_one")
    c, r = _ratio(F.col("found_near"), F.col("found_all")), _ratio(F.col("truth_near"), F.col("truth_all"))
    return both.withColumn("correctness", c).withColumn("completeness", r).withColumn("f1", _ratio(2 * c * r, c + r))


def line_segments(lines: DataFrame) -> DataFrame:
    """``fid, k, ax, ay, bx, by`` of each stretch of ``path`` that has a length."""
    heads, tails = F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path"))
    each = F.posexplode(F.zip_with(heads, tails, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))))
    return lines.filter(F.size("path") >= 2).select("fid", each.alias("k", "_s")).select("fid", "k", "_s.*").filter("ax <> bx OR ay <> by")


def _within(p: Column, step: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """The parameters t at which ``p + t * step`` lies between two bounds; nulls for none."""
    level = F.when(p.between(least, most), F.lit(1))
    one, two = (least - p) / step, (most - p) / step
    return (F.when(step == 0, F.lit(0.0) * level).otherwise(F.least(one, two)), F.when(step == 0, F.lit(1.0) * level).otherwise(F.greatest(one, two)))


def _near_stretch(pairs: DataFrame, d: float) -> DataFrame:
    """Adds ``lo, hi``: the part of segment a, as a share of its length, within d of segment ``c..e``; nulls for none.

    What lies within d of a segment is convex, so the part is one stretch: from the
    first to the last end of those in the two discs and in the band between them."""
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("ex") - F.col("cx"), F.col("ey") - F.col("cy")
    p = pin(pairs, _ux=ux, _uy=uy, _uu=ux * ux + uy * uy, _vx=vx, _vy=vy, _m=F.sqrt(vx * vx + vy * vy), _wx=F.col("ax") - F.col("cx"), _wy=F.col("ay") - F.col("cy"))
    c = lambda n: F.col(f"_{n}")

    def disc(wx: Column, wy: Column) -> Column:
        half, rest = wx * c("ux") + wy * c("uy"), wx * wx + wy * wy - d * d
        root = half * half - c("uu") * rest
        return F.when(root >= 0, F.struct(((-half - F.sqrt(root)) / c("uu")).alias("lo"), ((-half + F.sqrt(root)) / c("uu")).alias("hi")))

    across, along = c("wy") * c("vx") - c("wx") * c("vy"), c("wx") * c("vx") + c("wy") * c("vy")
    lane = _within(across, c("uy") * c("vx") - c("ux") * c("vy"), F.lit(-float(d)) * c("m"), F.lit(float(d)) * c("m"))
    slab = _within(along, c("ux") * c("vx") + c("uy") * c("vy"), F.lit(0.0), c("m") * c("m"))
    p = pin(p, _c=disc(c("wx"), c("wy")), _e=disc(c("wx") - c("vx"), c("wy") - c("vy")), _l0=lane[0], _l1=lane[1], _s0=slab[0], _s1=slab[1])
    band = F.when((c("m") > 0) & c("l0").isNotNull() & c("s0").isNotNull(), F.struct(F.greatest("_l0", "_s0").alias("lo"), F.least("_l1", "_s1").alias("hi")))
    there = F.filter(F.array("_c", "_e", band), lambda s: s.isNotNull() & s["lo"].isNotNull() & s["hi"].isNotNull())
    clipped = F.transform(there, lambda s: F.struct(F.greatest(s["lo"], F.lit(0.0)).alias("lo"), F.least(s["hi"], F.lit(1.0)).alias("hi")))
    real = pin(p, _r=F.filter(clipped, lambda s: s["lo"] <= s["hi"]))
    return real.withColumn("lo", F.array_min(F.transform("_r", lambda s: s["lo"]))).withColumn("hi", F.array_max(F.transform("_r", lambda s: s["hi"])))


def length_within(lines: DataFrame, others: DataFrame, d: float) -> DataFrame:
    """``length, near``: all of the lines, and what of them lies within d of the others, both exact.

    Segments meet in the grid cells they cross; equal segments of the others are one.
    The stretches of a segment near others are united, so none counts twice."""
    side = 2.0 * d
    own = materialize(line_segments(lines))
    there = crossed_cells(line_segments(others).select("ax", "ay", "bx", "by").distinct(), side)
    there = explode_around(there).select("i", "j", *[F.col(a).alias(b) for a, b in (("ax", "cx"), ("ay", "cy"), ("bx", "ex"), ("by", "ey"))]).distinct()
    pairs = meet(crossed_cells(own, side), there, ["i", "j"]).drop("i", "j").distinct()
    lane = Window.partitionBy("fid", "k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    size = distance(*[F.col(c) for c in ("ax", "ay", "bx", "by")])
    met = _near_stretch(pairs, d).filter("lo is not null").select("fid", "k", "lo", "hi", size.alias("_size")).withColumn("_done", F.max("hi").over(lane))
    new = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), F.coalesce("_done", F.lit(0.0))))
    near = met.agg(F.coalesce(F.sum(new * F.col("_size")), F.lit(0.0)).alias("near")).withColumn("_one", F.lit(1))
    return own.agg(F.coalesce(F.sum(size), F.lit(0.0)).alias("length")).withColumn("_one", F.lit(1)).join(near, "_one").drop("_one")


def buffer_lengths(found: DataFrame, truth: DataFrame, d: float) -> DataFrame:
    """``buffer_score`` on exact lengths: correctness is the share of the found network within d of
    the true one, completeness the other way round. ``fid, path``; a line's fid is unique."""
    def share(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        return length_within(p, q, d).select(F.col("length").alias(f"{name}_length"), F.col("near").alias(f"{name}_near"), F.lit(1).alias("_one"))
    both = share(found, truth, "found").join(share(truth, found, "truth"), "_one").drop("_one")
    c, r = _ratio(F.col("found_near"), F.col("found_length")), _ratio(F.col("truth_near"), F.col("truth_length"))
    return both.withColumn("correctness", c).withColumn("completeness", r).withColumn("f1", _ratio(2 * c * r, c + r))


def mask_score(found: DataFrame, truth: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Cell counts of two sparse masks: tp, fp, fn, precision, recall, f1, iou."""
    cell = ["raster_id", "row", "col"]
    both = found.select(*cell, F.lit(1).alias("_f")).join(truth.select(*cell, F.lit(1).alias("_t")), cell, "full_outer")
    f, t = F.col("_f").isNotNull(), F.col("_t").isNotNull()
    counts = both.agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    return _scores(counts).withColumn("iou", (F.col("tp") + eps) / (F.col("tp") + F.col("fp") + F.col("fn") + eps))


def point_score(found: DataFrame, truth: DataFrame, d: float) -> DataFrame:
    changes = compare_detections(truth, found, d)
    tally = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return _scores(changes.agg(tally("matched", "tp"), tally("new", "fp"), tally("lost", "fn")))


def dice(df: DataFrame, eps: float = 1e-6, image: str = "raster_id") -> DataFrame:
    """Dice loss of ``prob`` against ``truth`` per image and its mean over images."""
    per = df.groupBy(image).agg(F.sum(F.col("prob") * F.col("truth")).alias("_pt"), F.sum("prob").alias("_p"), F.sum("truth").alias("_t"))
    per = per.withColumn("dice_loss", 1 - (2 * F.col("_pt") + eps) / (F.col("_p") + F.col("_t") + eps))
    return per.agg(F.avg("dice_loss").alias("dice_loss"), F.count("*").alias("images"))

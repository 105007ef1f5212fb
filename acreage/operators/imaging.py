"""Tables of tiles, pixels and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DETECTION_PIXELS = 80


def _steps(length: Column, tile: int, stride: int) -> Column:
    """Tile origins along one side; the last tile is pushed back to end at the border."""
    last = F.greatest(length - tile, F.lit(0))
    regular = F.sequence(F.lit(0), last, F.lit(stride))
    return F.array_distinct(F.concat(regular, F.array(last)))


def tile_index(images: DataFrame, tile: int = 512, overlap: int = 64) -> DataFrame:
    """Sliding-window tiles of every image (``width``, ``height``)."""
    stride = tile - overlap
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    ys = images.withColumn("y", F.explode(_steps(h, tile, stride)))
    both = ys.withColumn("x", F.explode(_steps(w, tile, stride)))
    return both.withColumn("tile_w", F.least(w - F.col("x"), F.lit(tile))).withColumn("tile_h", F.least(h - F.col("y"), F.lit(tile)))


def hann(i: Column, size: int) -> Column:
    """Raised cosine over ``size`` samples."""
    return 0.5 - 0.5 * F.cos(i * (6.283185307179586 / (size - 1)))


def blend_tiles(probs: DataFrame, tile: int = 512) -> DataFrame:
    """Weighted mean of overlapping tile probabilities per image pixel and class.

    ``probs``: image_id, tile_x, tile_y, dx, dy, class_id, prob.
    """
    weight = F.greatest(F.lit(0.05), F.least(F.lit(1.0), hann(F.col("dy"), tile) * hann(F.col("dx"), tile)))
    w = probs.withColumn("w", weight)
    return w.groupBy("image_id", (F.col("tile_y") + F.col("dy")).alias("y"), (F.col("tile_x") + F.col("dx")).alias("x"), "class_id").agg(
        (F.sum(F.col("prob") * F.col("w")) / F.sum("w")).alias("prob")
    )


def argmax_class(probs: DataFrame) -> DataFrame:
    """Most probable class of every pixel; the lowest class wins ties."""
    return probs.groupBy("image_id", "y", "x").agg(F.max_by("class_id", F.struct("prob", (-F.col("class_id")).alias("c"))).alias("class_id"))


def class_pixel_counts(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id", "class_id").agg(F.count(F.lit(1)).alias("pixels")).withColumn(
        "has_detections", F.col("pixels") > MIN_DETECTION_PIXELS
    )


def classify_images(pixels: DataFrame) -> DataFrame:
    """Tone statistics of each image and the kind of input they point to.

    ``pixels``: image_id, gray, hue, sat, val (0–255, hue 0–180).
    """
    n = F.count(F.lit(1))
    ratio = lambda cond: F.count_if(cond) / n
    green = F.col("hue").between(32, 88) & (F.col("sat") >= 35) & (F.col("val") >= 35)
    stats = pixels.groupBy("image_id").agg(
        ratio(F.col("gray") > 210).alias("white_ratio"), ratio(F.col("gray") < 60).alias("dark_ratio"), ratio(green).alias("green_ratio"),
        F.avg("sat").alias("mean_sat"), F.stddev_pop("sat").alias("std_sat"),
    )
    kind = (
        F.when((F.col("white_ratio") > 0.65) & (F.col("mean_sat") < 35.0), "WHITE_PAGE_DRAWING")
        .when(F.col("dark_ratio") > 0.45, "CAD_TECHNICAL")
        .when(((F.col("mean_sat") > 25.0) & (F.col("std_sat") > 18.0)) | (F.col("green_ratio") > 0.12), "SATELLITE_AERIAL")
        .when(F.col("white_ratio") > 0.40, "WHITE_PAGE_DRAWING").otherwise("CAD_TECHNICAL")
    )
    return stats.withColumn("input_type", kind)

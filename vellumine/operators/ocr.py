"""Recognised words: table input, gate, scaling, text layer, and raster preparation."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_tsv(pages: DataFrame) -> DataFrame:
    """pages: page, tsv (header line, then 12 tab-separated fields). One row per word kept.

    Short rows, blank words and confidence -1 drop out; confidence is a share.
    """
    rows = pages.select("page", F.posexplode(F.split("tsv", "\n")).alias("n", "line")).where("n > 0")
    cells = rows.withColumn("c", F.split("line", "\t")).where(F.size("c") >= 12)
    get = lambda i: F.element_at("c", i + 1)
    number = lambda i: F.coalesce(get(i).try_cast("double"), F.lit(0.0))
    out = cells.select("page", "n", number(6).alias("x"), number(7).alias("y"), number(8).alias("width"), number(9).alias("height"), get(10).try_cast("double").alias("conf"), F.trim(get(11)).alias("text"))
    return out.where("text <> '' AND conf IS NOT NULL AND conf <> -1").withColumn("confidence", F.col("conf") / 100).drop("conf")


def page_text(words: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("n", "text")))
    return words.groupBy("page").agg(F.array_join(F.transform(held, lambda x: x["text"]), " ").alias("full_text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def gate(success: Column, mean: Column, threshold: float = 0.5) -> Column:
    return F.when(~success, "failed").when(mean < threshold, "uncertain").otherwise("applied")


def scaled(x: Column, y: Column, w: Column, h: Column, page: tuple, raster: tuple) -> Column:
    """A word's box from raster to page units; null for an empty raster."""
    fx, fy = F.try_divide(F.lit(page[0]), raster[0]), F.try_divide(F.lit(page[1]), raster[1])
    return F.struct((x * fx).alias("x"), (y * fy).alias("y"), (w * fx).alias("width"), (h * fy).alias("height"))


def font_size(width: Column, text: Column) -> Column:
    return F.greatest(F.lit(6.0), F.least(F.lit(24.0), 1.2 * width / F.greatest(F.octet_length(text), F.lit(1))))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, by pixel centres."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    im = image.astype(float)
    top = im[y0][:, x0] * (1 - fx) + im[y0][:, x1] * fx
    low = im[y1][:, x0] * (1 - fx) + im[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(np.uint8)


def despeckle(image: np.ndarray, dark: int = 128) -> np.ndarray:
    """Dark pixels (first channel) with at most one dark neighbour above, below, left or right turn white."""
    is_dark = image[..., 0] < dark
    around = np.pad(is_dark, 1)
    near = around[:-2, 1:-1].astype(int) + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:]
    out = image.copy()
    out[is_dark & (near <= 1), :3] = 255
    return out

"""Page measurements, regions and layout groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions import pixels
from markspan.operators.normalize import fallback_format
from markspan.operators.ordered import number_rows

# Grid and drawing-box rules.
GRID_CELLS = 10
MIN_BUBBLES, GRID_MARGIN = 10, 20
DRAWING_SHARE, DRAWING_MIN_RATIO, DRAWING_MAX_RATIO = 0.02, 0.5, 5


def blank_by_measures(
    std: Column, ink: Column, edge: Column,
    threshold: float = pixels.BLANK_STD, min_ink: float = pixels.BLANK_INK, min_edge: float = pixels.BLANK_EDGE,
) -> Column:
    """Low deviation, ink and edges together; a page that could not be measured is not blank."""
    return F.coalesce((std < threshold) & (ink < min_ink) & (edge < min_edge), F.lit(False))


def page_stats(pages: DataFrame) -> DataFrame:
    """Deviation, contrast, ink share and hash of each thumbnail; blankness by deviation."""
    px = F.col("pixels")
    return pages.withColumns(
        {
            "std_dev": pixels.std_dev(px),
            "contrast": pixels.contrast(px),
            "ink_ratio": pixels.ink_share(px),
            "image_hash": pixels.mean_hash(px),
        }
    ).withColumn("is_blank", F.col("std_dev") < pixels.BLANK_STD)


def page_quality(pages: DataFrame) -> DataFrame:
    lap = pages.withColumn("laplacian_var", pixels.laplacian_variance("pixels", "width"))
    return lap.withColumn("quality", pixels.quality(F.col("laplacian_var"), F.col("pixels")))


def header_regions(pages: DataFrame, threshold: float = pixels.BLANK_STD) -> DataFrame:
    """The top fifth of each page that has content, as a region row."""
    top = pixels.top_rows(F.col("pixels"), F.col("width"), F.col("height"))
    found = pages.withColumn("header_std", pixels.std_dev(top)).filter(F.col("header_std") > threshold)
    return found.select(
        "page_id", F.lit("header").alias("region_type"), F.lit(0).alias("x"), F.lit(0).alias("y"),
        F.col("width").alias("w"), F.floor(F.col("height") * pixels.HEADER_SHARE).cast("int").alias("h"), "header_std",
    )


def drawing_areas(boxes: DataFrame) -> DataFrame:
    area, ratio = F.col("w") * F.col("h"), F.col("w") / F.col("h")
    big = (F.col("h") > 0) & (area > F.col("page_w") * F.col("page_h") * DRAWING_SHARE)
    return boxes.filter(big & (ratio > DRAWING_MIN_RATIO) & (ratio < DRAWING_MAX_RATIO))


def answer_grids(circles: DataFrame) -> DataFrame:
    """The box around a page's circles when there are more than ten."""
    box = circles.groupBy("page").agg(
        (F.min("cx") - GRID_MARGIN).alias("x"),
        (F.min("cy") - GRID_MARGIN).alias("y"),
        (F.max("cx") - F.min("cx") + 2 * GRID_MARGIN).alias("w"),
        (F.max("cy") - F.min("cy") + 2 * GRID_MARGIN).alias("h"),
        F.count(F.lit(1)).alias("bubble_count"),
    )
    return box.filter(F.col("bubble_count") > MIN_BUBBLES)


def largest_regions(regions: DataFrame, region_type: str = "answer_grid") -> DataFrame:
    """Each page's largest region of a type; of equal areas the one nearest the top left."""
    grids = regions.filter(F.col("region_type") == region_type)
    best = grids.groupBy("page").agg(
        F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"), "w", "h")).alias("b")
    )
    return best.select("page", (-F.col("b.nx")).alias("x"), (-F.col("b.ny")).alias("y"), "b.w", "b.h", "b.area")


def layout_hashes(regions: DataFrame) -> DataFrame:
    """Fingerprint of each page's regions on a 10 x 10 grid.

    One shuffle, by page: the hashed text holds every region of the page, so they have to meet."""
    def cell(value: str, size: str) -> Column:
        return (F.col(value) / F.col(size) * GRID_CELLS).cast("bigint")

    place = F.concat_ws(",", cell("x", "page_w"), cell("y", "page_h"), cell("w", "page_w"), cell("h", "page_h"))
    listed = regions.groupBy("page").agg(F.array_sort(F.collect_list(F.concat_ws(":", "region_type", place))).alias("cells"))
    return listed.select("page", F.left(F.md5(F.array_join("cells", "|")), F.lit(12)).alias("layout_hash"))


def layout_clusters(hashes: DataFrame) -> DataFrame:
    """Pages and first page per layout."""
    return hashes.groupBy("layout_hash").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"))


def cluster_pages(hashes: DataFrame) -> DataFrame:
    """The pages of each layout in order, as rows (layout_hash, n, page)."""
    return number_rows(hashes.select("layout_hash", "page"), ["layout_hash"], [F.col("page")], "n")


def representative_pages(pages: DataFrame) -> DataFrame:
    """The best page per layout: highest quality, then first page; without any quality the first page."""
    seen = F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(0.0))
    return pages.groupBy("layout_hash").agg(F.max_by("page", F.struct(seen.alias("q"), (-F.col("page")).alias("p"))).alias("page"))


def attach_formats(pages: DataFrame, formats: DataFrame) -> DataFrame:
    """Each page with its layout's format, the fallback format where the layout has none."""
    wide = formats.withColumn("__known", F.lit(True))
    joined = pages.join(wide, pages["layout_hash"] == wide["format_id"], "left").drop(wide["format_id"])
    spare = fallback_format()
    known = F.coalesce("__known", F.lit(False))
    filled = {c: F.when(known, F.col(c)).otherwise(v) for c, v in spare.items() if c in formats.columns}
    return joined.withColumns(filled).withColumn("is_fallback", ~known).drop("__known")


def sample_pages(pages: DataFrame, k: int, mode: str = "even", keep_all: int = 5) -> DataFrame:
    """Example pages per document: the first or last `k`, or `k` evenly spaced; short documents are kept whole."""
    numbered = number_rows(pages, ["doc_id"], [F.col("page")], "n", "total")
    n, total = F.col("n"), F.col("total")
    step = F.greatest(F.lit(1), F.floor(total / k))
    rules = {
        "first": n <= k,
        "last": n > total - k,
        "even": ((n - 1) % step == 0) & (F.floor((n - 1) / step) < k),
    }
    return numbered.filter((total <= keep_all) | rules[mode]).select("doc_id", "page")

"""Presets as a dimension table (S-06 to S-08, S-19, O-04), vocabularies (S-10), images as files (S-04, S-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "category string, name string, kind string, priority int, psm int, confidence double, length int, hits int, steps string"
KINDS = ("cloud_vision", "linear_ingredient", "linear_table", "linear_text", "cell_based")
#: Category, name, kind, priority, page mode, least confidence, length and keyword hits, image steps with their
#: parameters, separated by semicolons.
PRESETS = [
    ("ingredients", "gcv_doc_text_ingredients", "cloud_vision", 5, 6, 65.0, 20, 1, ""),
    ("ingredients", "ingredient_psm4_otsu", "linear_ingredient", 10, 4, 50.0, 20, 1, "resize_max_height max_height=900; grayscale; clahe clip_limit=2.5 tile_grid_size=8,8; gaussian_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white"),
    ("ingredients", "ingredient_psm6_adaptive", "linear_ingredient", 20, 6, 45.0, 20, 1, "resize_max_height max_height=900; grayscale; clahe clip_limit=3.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=31 c=10; ensure_black_text_on_white"),
    ("ingredients", "ingredient_otsu_erosion", "linear_ingredient", 30, 4, 50.0, 20, 1, "resize_max_height max_height=900; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white; thin_text_if_thick dark_ratio_threshold=0.05"),
    ("ingredients", "ingredient_bilateral_adaptive", "linear_ingredient", 40, 6, 45.0, 20, 1, "resize_max_height max_height=900; grayscale; bilateral_filter diameter=9 sigma_color=75 sigma_space=75; adaptive_threshold block_size=51 c=15; ensure_black_text_on_white"),
    ("ingredients", "ingredient_sharpened_otsu", "linear_ingredient", 50, 4, 45.0, 20, 1, "resize_max_height max_height=900; grayscale; unsharp_mask kernel_size=5 amount=2.0; otsu_threshold; ensure_black_text_on_white"),
    ("table", "gcv_doc_text_table", "cloud_vision", 5, 6, 65.0, 40, 3, ""),
    ("table", "otsu_basic", "linear_table", 10, 6, 65.0, 40, 3, "resize_max_height max_height=500; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; median_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white"),
    ("table", "adaptive_threshold", "linear_table", 20, 6, 65.0, 40, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=41 c=14; ensure_black_text_on_white; thin_text_if_thick"),
    ("table", "adaptive_lineremoval", "linear_table", 30, 6, 70.0, 50, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=41 c=14; ensure_black_text_on_white; remove_grid_lines horizontal_divisor=20 vertical_divisor=20 min_line_area_ratio=0.004; median_blur kernel_size=3; thin_text_if_thick"),
    ("table", "clahe_otsu_lineremoval", "linear_table", 40, 6, 65.0, 40, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=3.0 tile_grid_size=8,8; median_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white; remove_grid_lines horizontal_divisor=18 vertical_divisor=18; thin_text_if_thick"),
    ("table", "aggressive_adaptive", "linear_table", 50, 4, 60.0, 40, 3, "resize_max_height max_height=700; resize_min_height min_height=400; grayscale; bilateral_filter diameter=7 sigma_color=60.0 sigma_space=60.0; unsharp_mask kernel_size=5 amount=1.2; clahe clip_limit=3.5 tile_grid_size=6,6; adaptive_threshold block_size=25 c=12; ensure_black_text_on_white; morph_close kernel_size=2 iterations=1; thin_text_if_thick"),
    ("table", "deskew_adaptive", "linear_table", 60, 6, 65.0, 40, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=41 c=14; ensure_black_text_on_white; deskew max_abs_angle=10.0; remove_grid_lines horizontal_divisor=20 vertical_divisor=20; median_blur kernel_size=3"),
    ("table", "cell_based_otsu", "cell_based", 70, 7, 55.0, 30, 2, "resize_max_height max_height=800; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; median_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white"),
    ("table", "cell_based_adaptive", "cell_based", 80, 7, 55.0, 30, 2, "resize_max_height max_height=800; grayscale; clahe clip_limit=2.5 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=35 c=12; ensure_black_text_on_white"),
    ("table", "highres_clahe_psm4", "linear_table", 90, 4, 60.0, 40, 3, "resize_max_height max_height=700; grayscale; clahe clip_limit=4.0 tile_grid_size=8,8; median_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white"),
    ("table", "bilateral_sharpen_otsu", "linear_table", 100, 6, 60.0, 40, 3, "resize_max_height max_height=500; grayscale; bilateral_filter diameter=9 sigma_color=75 sigma_space=75; unsharp_mask kernel_size=3 amount=1.5; otsu_threshold; ensure_black_text_on_white"),
    ("text", "gcv_doc_text_text", "cloud_vision", 5, 6, 65.0, 60, 3, ""),
    ("text", "otsu_psm6", "linear_text", 10, 6, 65.0, 60, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; median_blur kernel_size=3; otsu_threshold; ensure_black_text_on_white"),
    ("text", "adaptive_psm6", "linear_text", 20, 6, 65.0, 60, 3, "resize_max_height max_height=600; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=35 c=12; ensure_black_text_on_white; thin_text_if_thick"),
    ("text", "adaptive_psm4", "linear_text", 30, 4, 62.0, 60, 3, "resize_max_height max_height=700; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=41 c=14; ensure_black_text_on_white; thin_text_if_thick"),
    ("text", "deskew_psm3", "linear_text", 40, 3, 60.0, 60, 3, "resize_max_height max_height=700; grayscale; clahe clip_limit=2.0 tile_grid_size=8,8; gaussian_blur kernel_size=3; adaptive_threshold block_size=41 c=14; ensure_black_text_on_white; deskew max_abs_angle=10.0"),
    ("text", "aggressive_enhance", "linear_text", 90, 6, 55.0, 50, 2, "resize_max_height max_height=800; resize_min_height min_height=500; grayscale; bilateral_filter diameter=7 sigma_color=60.0 sigma_space=60.0; unsharp_mask kernel_size=5 amount=1.2; clahe clip_limit=3.5 tile_grid_size=6,6; adaptive_threshold block_size=25 c=12; ensure_black_text_on_white; morph_close kernel_size=2 iterations=1; thin_text_if_thick"),
]


def presets(spark: SparkSession) -> DataFrame:
    """S-08."""
    return spark.createDataFrame(PRESETS, SCHEMA)


def ordered(df: DataFrame) -> DataFrame:
    """O-04: by priority, then name."""
    return df.orderBy("priority", "name")


def listed(df: DataFrame) -> DataFrame:
    """S-19: (category, names): each category's presets in order."""
    entries = F.array_sort(F.collect_list(F.struct("priority", "name")))
    return df.groupBy("category").agg(F.array_join(F.transform(entries, lambda e: e["name"]), ",").alias("names"))


def read_presets(spark: SparkSession, folder: str) -> DataFrame:
    """S-06, S-07: preset files below a folder, one JSON object each; files without a required key, or of an unknown
    kind, fail the query when they are read."""
    raw = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema("name string, description string, kind string, priority int, steps array<map<string,string>>, ocr map<string,string>").json(folder)
    known = F.col("kind").isin(*KINDS) & F.col("name").isNotNull() & F.col("steps").isNotNull() & F.col("ocr").isNotNull()
    checked = raw.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("not a preset: "), F.input_file_name()))))
    category = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return checked.select(category.alias("category"), "name", "description", "kind", F.coalesce("priority", F.lit(100)).alias("priority"), step_text(F.col("steps")).alias("steps"), "ocr")


def step_text(steps: Column) -> Column:
    """Steps of a preset file, as PRESETS writes them: each one's op and its parameters, but for its own name."""
    pairs = lambda s: F.transform(F.map_entries(F.map_filter(s, lambda k, v: ~k.isin("op", "name"))), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), F.translate(e["value"], "[] ", "")))
    return F.array_join(F.transform(steps, lambda s: F.concat(s["op"], F.array_join(pairs(s), ""))), "; ")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """S-10: (word, n) of a tab file; comments and blanks are skipped, 100 where no number is given, a word's last line counts."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    cells = F.split("line", "\t", -1)
    words = lines.select("at", F.lower(F.trim(cells[0])).alias("word"), F.when(F.size(cells) > 1, cells[1].try_cast("int")).otherwise(100).alias("n")).where("word <> ''")
    return words.groupBy("word").agg(F.max_by("n", "at").alias("n"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """S-03, S-05: files as (path, length, content, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))

"""Column expressions on identifiers, file names and image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file suffixes, and the other suffixes a stem may be asked for under.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(base_name(path), r"^(.+)\.[^.]+$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def has_image_suffix(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def id_number(value: Column) -> Column:
    """Integer in the stem, with a mask marker removed; NULL when the stem is not a number."""
    plain = F.regexp_replace(stem(value), r"_mask_\d+$", "")
    return F.when(plain.rlike(r"^\d+$"), plain.cast("int"))


def first_number(value: Column) -> Column:
    """First digit run of the stem."""
    run = F.regexp_extract(stem(value), r"(\d+)", 1)
    return F.when(run != "", run.cast("int"))


def normalize_id(value: Column) -> Column:
    number = id_number(value)
    return F.when(number.isNotNull(), F.format_string("%06d.jpg", number))


def extract_number(value: Column) -> Column:
    """All digits of the stem without leading zeros; empty when there are none."""
    digits = F.regexp_replace(stem(value), r"[^0-9]", "")
    return F.regexp_replace(digits, r"^0+([0-9])", "$1")


def mask_base(name: Column) -> Column:
    """``000123_mask_004.png`` -> ``000123``; NULL for any other name."""
    base = F.regexp_extract(name, r"^(\d{6})_mask_\d+\.png$", 1)
    return F.when(base != "", base)


def mask_stem(name: Column) -> Column:
    return F.element_at(F.split(base_name(name), "_mask_"), 1)


def infer_group(name: Column) -> Column:
    """Group token of ``class_group_..._hexhash.ext``: first token after the class, hash dropped."""
    whole = stem(name)
    parts = F.split(whole, "_")
    payload = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.try_element_at(payload, F.lit(-1))
    trimmed = F.when(
        last.rlike(r"^[0-9a-fA-F]{8,}$"), F.slice(payload, 1, F.greatest(F.size(payload) - 1, F.lit(0)))
    ).otherwise(payload)
    first = F.try_element_at(trimmed, F.lit(1))
    return F.when(F.size(parts) < 2, whole).otherwise(F.coalesce(F.when(first != "", first), whole))


def safe_output_name(category: Column, path: Column) -> Column:
    safe = F.regexp_replace(stem(path), r"[^\p{L}\p{N}._-]", "_")
    return F.concat(category, F.lit("_"), safe, F.lit("_"), F.substring(F.sha1(path), 1, 8), F.lit(".png"))


def target_size(
    w: Column, h: Column, max_long: int | None = 1280, max_px: int | None = 1_400_000, min_short: int = 32
) -> Column:
    """struct(w, h) after the long-edge clamp, the area clamp and the short-edge floor, in turn.

    Half-even rounding at each step, never below one pixel.
    """

    def scaled(size: Column, ratio: Column, when: Column) -> Column:
        def side(name):
            return F.greatest(F.lit(1), F.bround(size[name] * ratio).cast("int"))

        return F.when(when, F.struct(side("w").alias("w"), side("h").alias("h"))).otherwise(size)

    size = F.struct(
        F.greatest(F.lit(1), w.cast("int")).alias("w"), F.greatest(F.lit(1), h.cast("int")).alias("h")
    )
    if max_long and max_long > 0:
        edge = F.greatest(size["w"], size["h"])
        size = scaled(size, F.lit(float(max_long)) / edge, edge > max_long)
    if max_px and max_px > 0:
        area = size["w"].cast("bigint") * size["h"].cast("bigint")
        size = scaled(size, F.sqrt(F.lit(float(max_px)) / area), area > max_px)
    edge = F.least(size["w"], size["h"])
    return scaled(size, F.lit(float(min_short)) / edge, edge < min_short)

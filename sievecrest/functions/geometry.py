"""Boxes, ratios and index-permuting views on row-major pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The view lists of the two test-time augmentation modes.
VIEWS = {
    "4way": ("identity", "hflip", "vflip", "rot90"),
    "8way": ("identity", "rot90", "rot180", "rot270", "hflip", "vflip", "transpose", "transverse"),
}


def _hits(px: Column, cut) -> Column:
    """Zero-based positions of pixels above a cut."""
    return F.filter(F.transform(px, lambda x, i: F.when(x > cut, i)), lambda i: i.isNotNull())


def foreground_bbox(px: Column, w: Column, threshold: int = 0) -> Column:
    """struct(left, top, right, bottom) around pixels above the threshold, right and bottom exclusive."""
    at = _hits(px, threshold)
    xs, ys = F.transform(at, lambda i: (i % w).cast("int")), F.transform(at, lambda i: F.floor(i / w).cast("int"))
    box = F.struct(
        F.array_min(xs).alias("left"),
        F.array_min(ys).alias("top"),
        (F.array_max(xs) + 1).alias("right"),
        (F.array_max(ys) + 1).alias("bottom"),
    )
    return F.when(F.size(at) > 0, box)


def mask_bbox(mask: Column, w: Column, h: Column) -> Column:
    """struct(x1, y1, x2, y2), inclusive; the whole frame for an empty mask."""
    box = foreground_bbox(mask, w, 0)
    return F.struct(
        F.coalesce(box["left"], F.lit(0)).alias("x1"),
        F.coalesce(box["top"], F.lit(0)).alias("y1"),
        F.coalesce(box["right"] - 1, w - 1).alias("x2"),
        F.coalesce(box["bottom"] - 1, h - 1).alias("y2"),
    )


def padded_bbox(box: Column, w: Column, h: Column, ratio: float) -> Column:
    pad = F.bround(F.greatest(box["right"] - box["left"], box["bottom"] - box["top"]) * ratio).cast("int")
    return F.struct(
        F.greatest(F.lit(0), box["left"] - pad).alias("left"),
        F.greatest(F.lit(0), box["top"] - pad).alias("top"),
        F.least(w, box["right"] + pad).alias("right"),
        F.least(h, box["bottom"] + pad).alias("bottom"),
    )


def expand_and_square(box: Column, w: Column, h: Column, margin: float) -> Column:
    """Grow the shorter side around its middle, pad by a margin of the side, clamp to the frame."""
    bw, bh = box["x2"] - box["x1"], box["y2"] - box["y1"]
    side = F.greatest(bw, bh)
    pad = F.floor(side * margin).cast("int")
    wide = bw > bh
    x1 = F.when(wide, box["x1"]).otherwise(box["x1"] - F.floor((bh - bw) / 2).cast("int"))
    y1 = F.when(wide, box["y1"] - F.floor((bw - bh) / 2).cast("int")).otherwise(box["y1"])
    x2 = F.when(wide, box["x2"]).otherwise(x1 + bh)
    y2 = F.when(wide, y1 + bw).otherwise(box["y2"])
    return F.struct(
        F.greatest(F.lit(0), x1 - pad).alias("x1"),
        F.greatest(F.lit(0), y1 - pad).alias("y1"),
        F.least(w - 1, x2 + pad).alias("x2"),
        F.least(h - 1, y2 + pad).alias("y2"),
    )


def crop(px: Column, w: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Row-major pixels of a box (right and bottom exclusive)."""
    rows = F.sequence(top, bottom - 1)
    return F.flatten(F.transform(rows, lambda y: F.slice(px, y * w + left + 1, right - left)))


def square_canvas(px: Column, w: Column, h: Column, fill: int = 0) -> Column:
    """Centre a grid on a square of its longer side."""
    side = F.greatest(w, h)
    dx, dy = F.floor((side - w) / 2).cast("int"), F.floor((side - h) / 2).cast("int")

    def cell(i: Column) -> Column:
        x, y = (i % side).cast("int") - dx, F.floor(i / side).cast("int") - dy
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        return F.when(inside, F.try_element_at(px, y * w + x + 1)).otherwise(F.lit(fill))

    return F.transform(F.sequence(F.lit(0), side * side - 1), cell)


def apply_mask(px: Column, mask: Column, invert: bool = False) -> Column:
    """Zero outside the mask (inside it when inverted)."""
    return F.zip_with(px, mask, lambda x, m: F.when((m == 0) if invert else (m > 0), x).otherwise(F.lit(0)))


def soft_mask(px: Column, mask: Column, invert: bool = False) -> Column:
    """``px * mask / 255`` truncated to 0..255."""

    def mix(x, m):
        share = m / F.lit(255.0)
        value = x * ((1.0 - share) if invert else share)
        return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")

    return F.zip_with(px, mask, mix)


def bbox_area_ratio(box: Column, w: Column, h: Column) -> Column:
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"]) / (w * h).cast("double")


def foreground_ratio(px: Column, threshold: int = 0) -> Column:
    return F.size(F.filter(px, lambda x: x > threshold)) / F.size(px)


def white_ratio(px: Column) -> Column:
    """Share of pixels that are fully white; 0.0 for an unreadable image."""
    share = F.size(F.filter(px, lambda x: x == 255)) / F.size(px)
    return F.coalesce(F.when(F.size(px) > 0, share), F.lit(0.0))


def view(px: Column, w: Column, h: Column, name: str) -> Column:
    """A flipped, turned or transposed grid; turned views have height ``w`` and width ``h``."""
    turned = name in ("rot90", "rot270", "transpose", "transverse")
    out_w = h if turned else w

    def source(i: Column) -> Column:
        r, c = F.floor(i / out_w).cast("int"), (i % out_w).cast("int")
        y, x = {
            "identity": (r, c),
            "hflip": (r, w - 1 - c),
            "vflip": (h - 1 - r, c),
            "rot90": (c, w - 1 - r),
            "rot180": (h - 1 - r, w - 1 - c),
            "rot270": (h - 1 - c, r),
            "transpose": (c, r),
            "transverse": (h - 1 - c, w - 1 - r),
        }[name]
        return F.element_at(px, y * w + x + 1)

    return F.transform(F.sequence(F.lit(0), F.size(px) - 1), source)

"""Boxes as columns; boxes are array<double> of x1, y1, x2, y2 in pixels, null where there is none."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance outside the image, widening of a crop, its size in pixels, and the padding's grey level.
TOLERANCE, EXPAND, CROP_SIZE, PADDING = 0.02, 0.15, 518, 114


def _at(box: Column, i: int) -> Column:
    return F.try_element_at(box, F.lit(i + 1))


def box_fault(box: Column, width: Column, height: Column) -> Column:
    """invalid_bbox_order, bbox_out_of_image, or null for a good box and for none. The order is tested first."""
    x1, y1, x2, y2 = (_at(box, i) for i in range(4))
    order = (x1 >= x2) | (y1 >= y2)
    out = (x2 > width * (1 + TOLERANCE)) | (y2 > height * (1 + TOLERANCE)) | (x1 < -width * TOLERANCE) | (y1 < -height * TOLERANCE)
    return F.when(order, "invalid_bbox_order").when(out, "bbox_out_of_image")


def xywh_to_xyxy(box: Column) -> Column:
    """Corner and size to two corners."""
    return F.array(_at(box, 0), _at(box, 1), _at(box, 0) + _at(box, 2), _at(box, 1) + _at(box, 3))


def normalised(box: Column, width: Column, height: Column) -> Column:
    """Struct cx, cy, w, h: the box cut to the image, as shares of its sides; null for a null box or an image without size."""
    x1, y1 = F.greatest(F.lit(0.0), _at(box, 0)), F.greatest(F.lit(0.0), _at(box, 1))
    x2, y2 = F.least(width.cast("double"), _at(box, 2)), F.least(height.cast("double"), _at(box, 3))
    w, h = F.nullif(width.cast("double"), F.lit(0.0)), F.nullif(height.cast("double"), F.lit(0.0))
    made = F.struct(((x1 + x2) / 2 / w).alias("cx"), ((y1 + y2) / 2 / h).alias("cy"), ((x2 - x1) / w).alias("w"), ((y2 - y1) / h).alias("h"))
    return F.when(box.isNotNull() & w.isNotNull() & h.isNotNull(), made)


def label_line(kind: int, box: Column, width: Column, height: Column) -> Column:
    """A detector's label line: class, centre and size with six decimals."""
    b = normalised(box, width, height)
    return F.when(b.isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(kind), b["cx"], b["cy"], b["w"], b["h"]))


def crop(box: Column, width: Column, height: Column, expand: float = EXPAND) -> Column:
    """Struct of the standard crop: window ix1..iy2 within the image, side of the padded square, and offsets of the window in it.

    Each side is widened by ``expand`` of the box, squared on the longer side about the centre, rounded half
    to even and cut to the image; what is missing to a square is padding on both sides. A box that is null or not
    four finite numbers has none.
    """
    x1, y1, x2, y2 = (_at(box, i) for i in range(4))
    bw, bh = x2 - x1, y2 - y1
    left, top, right, bottom = x1 - bw * expand, y1 - bh * expand, x2 + bw * expand, y2 + bh * expand
    half = F.greatest(right - left, bottom - top) / 2
    cx, cy = (left + right) / 2, (top + bottom) / 2
    ix1 = F.greatest(F.lit(0), F.rint(cx - half).try_cast("int"))
    iy1 = F.greatest(F.lit(0), F.rint(cy - half).try_cast("int"))
    ix2 = F.least(width.cast("int"), F.rint(cx + half).try_cast("int"))
    iy2 = F.least(height.cast("int"), F.rint(cy + half).try_cast("int"))
    cw, ch = ix2 - ix1, iy2 - iy1
    side = F.greatest(cw, ch)
    made = F.struct(
        ix1.alias("ix1"),
        iy1.alias("iy1"),
        ix2.alias("ix2"),
        iy2.alias("iy2"),
        side.alias("side_px"),
        F.floor((side - cw) / 2).cast("int").alias("off_x"),
        F.floor((side - ch) / 2).cast("int").alias("off_y"),
    )
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(box.isNotNull() & (F.size(box) == 4) & finite, made)


def crop_window(box: list[float], width: int, height: int, expand: float = EXPAND) -> dict[str, int] | None:
    """``crop`` of one box in a Python worker that has the pixels at hand."""
    if len(box) != 4 or not all(math.isfinite(x) for x in box):
        return None
    x1, y1, x2, y2 = box
    bw, bh = x2 - x1, y2 - y1
    left, top, right, bottom = x1 - bw * expand, y1 - bh * expand, x2 + bw * expand, y2 + bh * expand
    half = max(right - left, bottom - top) / 2
    cx, cy = (left + right) / 2, (top + bottom) / 2
    ix1, iy1 = max(0, round(cx - half)), max(0, round(cy - half))
    ix2, iy2 = min(width, round(cx + half)), min(height, round(cy + half))
    cw, ch = ix2 - ix1, iy2 - iy1
    side = max(cw, ch)
    return {"ix1": ix1, "iy1": iy1, "ix2": ix2, "iy2": iy2, "side_px": side, "off_x": (side - cw) // 2, "off_y": (side - ch) // 2}

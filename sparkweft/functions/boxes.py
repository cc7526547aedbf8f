"""Text boxes of recognised pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkweft.functions.binding import let
from sparkweft.functions.text import correct_text

# Known misreadings and the right words.
CORRECTIONS = {
    "消点宝经济型": "捎点宝经济型",
    "消点宝出行": "捎点宝出行",
    "背操出行": "曹操出行",
    "费操出行": "曹操出行",
}


def quad_to_box(point: Column, corrections: Mapping[str, str] = CORRECTIONS) -> Column:
    """Box of a quadrilateral ``{text, confidence, text_region}``.

    The two lowest and two highest coordinates of each axis are averaged. ``x``/``y`` are the left and top edge,
    ``w``/``h`` the right and bottom edge, ``c`` the confidence to three decimals (half up).
    """

    def axis(number: int) -> Column:
        return F.sort_array(F.transform(point["text_region"], lambda corner: F.get(corner, F.lit(number)).cast("double")))

    def low(values: Column) -> Column:
        return (F.element_at(values, 1) + F.element_at(values, 2)) / 2

    def high(values: Column) -> Column:
        return (F.element_at(values, -1) + F.element_at(values, -2)) / 2

    def box(xs: Column, ys: Column) -> Column:
        return F.struct(
            high(ys).alias("h"),
            correct_text(point["text"], corrections).alias("text"),
            high(xs).alias("w"),
            low(xs).alias("x"),
            low(ys).alias("y"),
            F.round(point["confidence"].cast("double"), 3).alias("c"),
        )

    return let(axis(0), lambda xs: let(axis(1), lambda ys: box(xs, ys)))


def page_boxes(points: Column, corrections: Mapping[str, str] = CORRECTIONS) -> Column:
    """Boxes of all quadrilaterals of a page, in page order."""
    return F.transform(points, lambda point: quad_to_box(point, corrections))


def page_text(boxes: Column) -> Column:
    """Texts of the boxes joined by commas."""
    return F.array_join(F.transform(boxes, lambda box: box["text"]), ",", "")

"""Multi-resolution crop arithmetic on image sizes; no pixels."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt import config as C
from pixelquilt.functions.binding import let, let_all


def _big(value: Column | int) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else value.cast("bigint")


def best_resolution(width: Column, height: Column, candidates: list[tuple[int, int]]) -> Column:
    """The candidate keeping most of the image, then wasting least, then listed first: ``struct<tw, th>``."""

    def scored(v: Column, index: int, tw: int, th: int) -> Column:
        scale = F.least(F.lit(float(tw)) / v["w"], F.lit(float(th)) / v["h"])

        def score(s: Column) -> Column:
            kept = F.least((v["w"] * s).cast("bigint") * (v["h"] * s).cast("bigint"), v["w"] * v["h"])
            return F.struct(
                kept.alias("kept"),
                (kept - F.lit(tw * th)).alias("unwasted"),
                F.lit(-index).alias("first"),
                F.lit(tw).cast("bigint").alias("tw"),
                F.lit(th).cast("bigint").alias("th"),
            )

        return let(scale, score)

    def choose(v: Column) -> Column:
        scores = F.array(*[scored(v, i, tw, th) for i, (tw, th) in enumerate(candidates)])
        best = let(F.array_max(scores), lambda b: F.struct(b["tw"].alias("tw"), b["th"].alias("th")))
        # No size, no choice: the comparisons above would skip a null.
        return F.when(v["w"].isNotNull() & v["h"].isNotNull(), best)

    return let_all({"w": _big(width), "h": _big(height)}, choose)


def middle_candidates(edge: int = C.SHORTEST_EDGE) -> list[tuple[int, int]]:
    return [(2 * edge, 2 * edge), (edge, 4 * edge), (4 * edge, edge)]


def parse_candidates(pinpoints: str | list) -> list[tuple[int, int]]:
    """A candidate list given as a list or as its text form, e.g. ``"[(336, 672), (672, 336)]"``."""
    if isinstance(pinpoints, str):
        pinpoints = json.loads(pinpoints.replace("(", "[").replace(")", "]"))
    return [(int(w), int(h)) for w, h in pinpoints]


def patch_boxes(width: Column, height: Column, patch: Column | int) -> Column:
    """Row-major boxes of a stepped grid; the last row and column may overhang the image."""
    step = _big(patch)

    def steps(size: Column) -> Column:
        return F.ceil(_big(size) / step).cast("bigint")

    def grid(v: Column) -> Column:
        def box(i: Column) -> Column:
            return let_all(
                {"left": (i % v["across"]) * v["step"], "top": F.floor(i / v["across"]).cast("bigint") * v["step"]},
                lambda b: F.struct(
                    i.alias("patch"),
                    b["left"].alias("x0"),
                    b["top"].alias("y0"),
                    (b["left"] + v["step"]).alias("x1"),
                    (b["top"] + v["step"]).alias("y1"),
                ),
            )

        return F.transform(F.sequence(F.lit(0).cast("bigint"), v["across"] * v["down"] - 1), box)

    return let_all({"across": steps(width), "down": steps(height), "step": step}, grid)


def crop_boxes(width: Column, height: Column, edge: int = C.SHORTEST_EDGE) -> Column:
    """41 crops of an image: the whole at (edge, edge), 4 of the middle grid, 36 of the grid three times as large.

    Each entry names the size the image is resized to (aspect not kept) and the box cut out of it.
    """
    side = F.lit(edge).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def level(name: str, rw: Column, rh: Column, first: int) -> Column:
        return F.transform(
            patch_boxes(rw, rh, edge),
            lambda b: F.struct(
                (b["patch"] + first).alias("crop_id"),
                F.lit(name).alias("level"),
                rw.alias("resize_w"),
                rh.alias("resize_h"),
                b["x0"].alias("x0"),
                b["y0"].alias("y0"),
                b["x1"].alias("x1"),
                b["y1"].alias("y1"),
            ),
        )

    whole = F.array(
        F.struct(
            zero.alias("crop_id"),
            F.lit("whole").alias("level"),
            side.alias("resize_w"),
            side.alias("resize_h"),
            zero.alias("x0"),
            zero.alias("y0"),
            side.alias("x1"),
            side.alias("y1"),
        )
    )
    return let(
        best_resolution(width, height, middle_candidates(edge)),
        lambda best: F.concat(
            whole,
            level("middle", best["tw"], best["th"], 1),
            level("high", best["tw"] * 3, best["th"] * 3, 5),
        ),
    )


def fit_and_pad(width: Column, height: Column, tw: Column | int, th: Column | int) -> Column:
    """Letterbox geometry: the resized size and the centred paste offset."""
    tw, th = _big(tw), _big(th)
    scale_w, scale_h = tw / width, th / height
    by_width = scale_w < scale_h
    new_w = F.when(by_width, tw).otherwise(F.least(F.ceil(width * scale_h).cast("bigint"), tw))
    new_h = F.when(by_width, F.least(F.ceil(height * scale_w).cast("bigint"), th)).otherwise(th)
    placed = F.struct(
        new_w.alias("nw"),
        new_h.alias("nh"),
        F.floor((tw - new_w) / 2).cast("bigint").alias("px"),
        F.floor((th - new_h) / 2).cast("bigint").alias("py"),
    )
    return F.when(width.isNotNull() & height.isNotNull(), placed)


def grid_shape(width: Column, height: Column, pinpoints: str | list, patch: int) -> Column:
    return let(
        best_resolution(width, height, parse_candidates(pinpoints)),
        lambda best: F.struct(
            F.floor(best["tw"] / patch).cast("bigint").alias("across"),
            F.floor(best["th"] / patch).cast("bigint").alias("down"),
        ),
    )


def fit_scale(height: Column, width: Column, th: Column, tw: Column) -> Column:
    """1.0 where the image fits the target, else the factor that makes it fit."""
    by_height, by_width = th.cast("double") / height, tw.cast("double") / width
    smaller = F.when(by_height < by_width, by_height).when(by_height >= by_width, by_width)
    return F.when((width <= tw) & (height <= th), F.lit(1.0)).otherwise(smaller)

"""Accessibility trees as text: one line an element, depth in tabs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BID = re.compile(r"\[([0-9]+)\]")


def visible_ids(properties: Column, least: float = 0.5) -> Column:
    """Ids, as strings, of elements with a visibility of `least` or more."""
    return F.array_sort(F.map_keys(F.map_filter(properties, lambda k, v: F.coalesce(v["visibility"] >= least, F.lit(False)))))


def parse_lines(tree: Column) -> Column:
    """array<struct(n, depth, bid, line)>: tabs in front, first [number] anywhere in the line."""
    def one(line: Column, n: Column) -> Column:
        bid = F.regexp_extract(line, r"\[(\d+)\]", 1)
        return F.struct(n.alias("n"), (F.length(line) - F.length(F.ltrim(line, F.lit("\t")))).alias("depth"), F.when(bid != "", bid).alias("bid"), line.alias("line"))

    return F.transform(F.split(tree, "\n", -1), one)


def _kept_lines(tree: str, ids: set[str]) -> str:
    """One pass down for depths and shown lines, then up the chains, each line once."""
    lines = tree.split("\n")
    depths = [len(x) - len(x.lstrip("\t")) for x in lines]
    shown = [bool((m := _BID.search(x)) and m[1] in ids) for x in lines]
    up: list[int | None] = []  # by line: the nearest one above of exactly one level less
    latest: dict[int, int] = {}
    open_: list[int] = []  # lines that can still have children, depths rising
    kept = set()
    for i, d in enumerate(depths):
        up.append(latest.get(d - 1))
        latest[d] = i
        while open_ and depths[open_[-1]] >= d:
            open_.pop()
        child = open_ and depths[open_[-1]] == d - 1 and shown[open_[-1]]
        if shown[i] or child and "StaticText" in lines[i]:
            kept.add(i)
        open_.append(i)
    for i in list(kept):
        above = up[i]
        while above is not None and above not in kept:
            kept.add(above)
            above = up[above]  # where it stops, that line has climbed its own chain or will
    return "\n".join(lines[i] for i in sorted(kept))


@F.arrow_udf(T.StringType())
def _keep(trees: pa.Array, ids: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _kept_lines(t, set(x or ())) for t, x in zip(trees.to_pylist(), ids.to_pylist(), strict=True)], pa.string())


def keep_visible(tree: Column, ids: Column) -> Column:
    """The visible lines, their direct StaticText children, and the ancestors of both.

    A child belongs to the nearest line above it that is no deeper than one level up. An ancestor is the nearest line
    above of exactly the depth sought, one level less each time, passing over all others. A null tree stays null; null
    ids show nothing. Runs on Arrow batches, in time linear in the tree: array functions would search it anew for each line.
    """
    return _keep(tree, ids.cast("array<string>"))


def bbox_scale(*candidates: Column) -> Column:
    """The scale of bounding boxes: the largest candidate, 1 at least."""
    return F.greatest(F.lit(1.0), *candidates)


def viewport_state(page: Column) -> Column:
    """struct of a page's measures (width, height of the viewport and of the window, scale, pixel ratio, scroll)."""
    known = lambda num, den: F.when(F.coalesce(den, F.lit(0)) != 0, num / den)
    scale = bbox_scale(page["scale"].cast("double"), known(page["width"], page["inner_width"]), known(page["height"], page["inner_height"]))
    return F.struct(page["inner_width"].alias("viewport_width"), page["inner_height"].alias("viewport_height"), page["ratio"].alias("device_scale_factor"), F.lit("viewport").alias("bbox_coordinate_space"), scale.alias("bbox_scale_factor"), page["scroll_x"].alias("scroll_x"), page["scroll_y"].alias("scroll_y"))

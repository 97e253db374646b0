"""Greedy choices along the axis whose every step depends on the last one, made in all tiles at once.

A tile turns the choice that comes in, a place and its value, into the one that goes out. That map is small: only what lies within reach of the tile's
begin decides where a chain of choices is entered, and each entry leads to one end. Tiles give their maps, the maps are composed in order (one row per tile), and
every tile then repeats its choices from what came in.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import bin_of

MAP = "chrom string, tile long, heads array<double>, tops array<double>, ends array<double>, end_values array<double>"
STATE = "chrom string, tile long, came double, came_value double, lost boolean"


def _next_choices(place: np.ndarray, value: np.ndarray | None, width: int) -> np.ndarray:
    """For each row, chosen, the row that is chosen next: the first one further away than ``width``, or before that the first one of a larger value."""
    far = np.searchsorted(place, place + width, side="right")
    if value is None:
        return far
    larger, open_ = np.full(len(place), len(place)), []
    for i, v in enumerate(value.tolist()):
        while open_ and value[open_[-1]] < v:
            larger[open_.pop()] = i
        open_.append(i)
    return np.minimum(far, larger)


def _tile_map(tile: int, size: int, place: np.ndarray, value: np.ndarray | None, width: int) -> tuple[list, list, list, list]:
    """Of the rows in reach of an earlier choice and one more: places, largest values so far, and the last choice of the chain from there on."""
    following, end = _next_choices(place, value, width).tolist(), list(range(len(place)))
    for i in range(len(place) - 1, -1, -1):
        if following[i] < len(place):
            end[i] = end[following[i]]
    heads = min(len(place), int(np.searchsorted(place, tile * size + width, side="right")) + 1)
    last = np.array(end[:heads], dtype=np.int64)
    worth = np.zeros(len(place)) if value is None else value
    return place[:heads].astype(float).tolist(), np.maximum.accumulate(worth[:heads]).tolist(), place[last].astype(float).tolist(), worth[last].tolist()


def choose(df: DataFrame, place: str, width: int, better: str | None, order: list[str], tile: int) -> DataFrame:
    """Rows (chrom, ``place``, ...) that are left of a greedy choice in order of ``order``, which begins with ``place``.

    A row further than ``width`` after the last choice is chosen as well. One within ``width`` is passed over; but if its ``better`` (a numeric column; none: never)
    is larger than that of the last choice, it takes the place of that one. Places are whole numbers below 2**53. A tile holds at least four widths.
    """
    size = max(tile, 4 * width)
    columns = df.columns
    keyed = df.withColumn("tile", bin_of(F.col(place), size)).repartition("chrom", "tile").sortWithinPartitions("chrom", "tile", *order)

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray | None]]:
        held, key = [], None
        for f in frames:
            for k, g in f.groupby(["chrom", "tile"], sort=False):
                if k != key and held:
                    yield (*key, *parts(held))
                    held = []
                key = k
                held.append(g)
        if held:
            yield (*key, *parts(held))

    def parts(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray | None]:
        return np.concatenate([g["place"] for g in held]), np.concatenate([g["worth"] for g in held]) if better else None

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chrom, t, p, v in tiles(frames):
            yield pd.DataFrame([(chrom, t, *_tile_map(t, size, p, v, width))], columns=["chrom", "tile", "heads", "tops", "ends", "end_values"])

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # ``waiting``: the tile that made the last choice, until it is known whether that one is replaced
        chrom, state, waiting = None, None, None
        for f in frames:
            out = []
            for c, t, heads, tops, ends, values in zip(*(f[x] for x in ("chrom", "tile", "heads", "tops", "ends", "end_values")), strict=True):
                if c != chrom:
                    out += [waiting] if waiting else []
                    chrom, state, waiting = c, None, None
                came = state or (None, None)
                far = bisect_right(heads, state[0] + width) if state else 0
                entry = min(far, bisect_right(tops, state[1])) if state and better else far
                if entry == len(heads):
                    out.append((c, t, *came, False))
                    continue
                if waiting:
                    out.append((*waiting[:4], entry < far))
                waiting, state = (c, t, *came, False), (ends[entry], values[entry])
            yield pd.DataFrame(out, columns=["chrom", "tile", "came", "came_value", "lost"])
        yield pd.DataFrame([waiting] if waiting else [], columns=["chrom", "tile", "came", "came_value", "lost"])

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, worth, held, lost = None, None, None, None, False
        for f in frames:
            rows, out = list(f[columns].itertuples(index=False, name=None)), []
            for row, c, t, p, v, came, came_value, gone in zip(rows, *(f[x].tolist() for x in ("chrom", "tile", "place", "worth", "came", "came_value", "lost")), strict=True):
                if (c, t) != key:
                    out += [held] if held and not lost else []
                    key, held, lost = (c, t), None, gone
                    last, worth = (None, None) if came is None or came != came else (came, came_value)
                if last is not None and p - last <= width:
                    if better and v > worth:
                        held, last, worth = row, p, v
                else:
                    out += [held] if held else []
                    held, last, worth = row, p, v
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([held] if held and not lost else [], columns=columns)

    rows = keyed.withColumns({"place": F.col(place).cast("long"), "worth": F.col(better).cast("double") if better else F.lit(0.0)})
    spine = rows.select("chrom", "tile", "place", "worth").mapInPandas(maps, MAP).repartition("chrom").sortWithinPartitions("chrom", "tile").mapInPandas(compose, STATE)
    placed = rows.join(spine, ["chrom", "tile"]).repartition("chrom", "tile").sortWithinPartitions("chrom", "tile", *order)
    return placed.mapInPandas(apply, df.schema)

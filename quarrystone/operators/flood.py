"""Sinks of a whole raster filled by a priority flood in parallel.

A cell's filled height is the least height at which water gets from it to the rim: the raster's edge or a void. Each tile is
flooded from its own border, and every border cell that the flood begins at names the part of the tile that drains to it.
Parts touch each other in a tile or across tiles at the least height of a pair of neighbours: a graph far smaller than the
raster. The least height from every part to the rim follows from Borůvka rounds: a part, or parts merged so far, must at least
rise to its lowest way out, and merges with what lies there. The parts' heights then lift their cells.

Cells without a value are voids and stay out of the result. No task holds more than a tile, no graph reaches the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.lineage import settled

RIM = 0
_AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]
_OUT = "row long, col long, v double, part long, other long"


def _tile_flooded(size: int):
    def flood(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tile_row, tile_col = (int(k) for k in key)
        r, c = rows["row"].to_numpy() - tile_row * size, rows["col"].to_numpy() - tile_col * size
        v = np.full((size, size), np.nan)
        v[r, c] = rows["v"]
        known = ~np.isnan(v)
        padded = np.pad(known, 1, constant_values=True)
        beside_void = known & ~np.logical_and.reduce([padded[1 + i : size + 1 + i, 1 + j : size + 1 + j] for i, j in _AROUND])
        border = np.zeros_like(known)
        border[[0, -1], :] = border[:, [0, -1]] = True
        part = np.full((size, size), -1, np.int64)
        part[beside_void] = RIM
        queued = known & (border | beside_void)
        heap = [(v[i, j], i, j) for i, j in np.argwhere(queued).tolist()]
        heapq.heapify(heap)
        first, n, meets = (tile_row << 36) + (tile_col << 16), 0, {}
        while heap:
            level, i, j = heapq.heappop(heap)
            if part[i, j] < 0:
                n += 1
                part[i, j] = first + n
            own = part[i, j]
            for di, dj in _AROUND:
                x, y = i + di, j + dj
                if not (0 <= x < size and 0 <= y < size and known[x, y]):
                    continue
                if part[x, y] < 0:
                    part[x, y] = own
                    if not queued[x, y]:
                        queued[x, y] = True
                        v[x, y] = max(v[x, y], level)
                        heapq.heappush(heap, (v[x, y], x, y))
                elif part[x, y] != own:
                    pair = (int(own), int(part[x, y]))
                    meets[pair] = min(meets.get(pair, np.inf), max(level, v[x, y]))
        cells = pd.DataFrame({"row": rows["row"], "col": rows["col"], "v": v[r, c], "part": part[r, c], "other": pd.array([None] * len(rows), "Int64")})
        if not meets:
            return cells
        pairs = pd.DataFrame({"row": pd.array([None] * len(meets), "Int64"), "col": pd.array([None] * len(meets), "Int64"), "v": list(meets.values()), "part": [a for a, _ in meets], "other": [b for _, b in meets]})
        return pd.concat([cells, pairs])

    return flood


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b, h) in both directions, the lowest of each pair."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "h")
    return edges.unionByName(back).where("a <> b").groupBy("a", "b").agg(F.min("h").alias("h"))


def heights_to_rim(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Of undirected edges (a, b, h): part and level, the least height at which each part reaches RIM.

    In a round every merged part takes its lowest edge (ties by the edge's ends, so rounds end); heights along the edges taken never
    rise, so a part pays its own edge alone. Rounds grow with the logarithm of the number of parts.
    """
    edges = settled(_both_ways(edges))
    parts = edges.select(F.col("a").alias("part")).distinct().where(F.col("part") != RIM).select("part", F.col("part").alias("whole"), F.lit(float("-inf")).alias("level"))
    for _ in range(most_rounds):
        lowest = edges.where(F.col("a") != RIM).groupBy("a").agg(F.min(F.struct("h", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "b")).alias("e"))
        lowest = settled(lowest.select("a", F.col("e.h").alias("h"), F.col("e.b").alias("b")))
        if lowest.isEmpty():
            return parts.select("part", "level")
        # of two that take each other the smaller stays
        other = lowest.select(F.col("a").alias("b"), F.col("b").alias("back"))
        up = lowest.join(other, "b", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root"))
        while True:
            up = settled(up)
            further = up.select(F.col("a").alias("root"), F.col("root").alias("next"))
            jumped = up.join(further, "root", "left").select("a", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = settled(jumped)
            up = jumped.select("a", "root")
            if jumped.where("moved").isEmpty():
                break
        paid = parts.join(lowest.select(F.col("a").alias("whole"), "h"), "whole", "left").select("part", "whole", F.greatest("level", "h").alias("level"))
        parts = settled(paid.join(up.select(F.col("a").alias("whole"), "root"), "whole", "left").select("part", F.coalesce("root", "whole").alias("whole"), "level"))
        to = lambda side: up.select(F.col("a").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "h")
        edges = settled(_both_ways(moved))
    raise ValueError(f"the rim was not reached within {most_rounds} rounds")


def filled(raster: DataFrame, size: int = 256) -> DataFrame:
    """row, col, v of the cells with a value, each raised to the least height from which water gets to the rim.

    ``size`` is a tile's side (at most 8,192), which bounds a task's memory and changes no value. Rows and columns are not negative.
    """
    cells = raster.where("v is not null and not isnan(v)").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "v")
    keyed = cells.withColumns({"tile_row": F.floor(F.col("row") / size), "tile_col": F.floor(F.col("col") / size)})
    flooded = settled(keyed.groupBy("tile_row", "tile_col").applyInPandas(_tile_flooded(size), _OUT))
    cells, inner = flooded.where("other is null").drop("other"), flooded.where("other is not null").select(F.col("part").alias("a"), F.col("other").alias("b"), F.col("v").alias("h"))
    edge = lambda x: F.pmod(F.col(x), F.lit(size)).isin(0, size - 1)
    border = cells.where(edge("row") | edge("col")).select("row", "col", F.col("v").alias("h"), F.col("part").alias("a"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in _AROUND]))
    beside = border.withColumn("s", steps).select("a", "h", "row", "col", (F.col("row") + F.col("s.r")).alias("r"), (F.col("col") + F.col("s.c")).alias("c"))
    beyond = beside.where((F.floor(F.col("r") / size) != F.floor(F.col("row") / size)) | (F.floor(F.col("c") / size) != F.floor(F.col("col") / size)))
    met = beyond.join(border.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("h").alias("h2"), F.col("a").alias("b")), ["r", "c"], "left")
    across = met.select("a", F.coalesce("b", F.lit(RIM)).alias("b"), F.greatest("h", "h2").alias("h"))
    levels = heights_to_rim(inner.unionByName(across))
    return cells.join(levels, "part", "left").select("row", "col", F.greatest("v", "level").alias("v"))

"""Electric current through a grid of resistances, solved exactly by merging squares of cells."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spurline.operators.lattice import blocks, upsampled
from spurline.operators.squares import tile_of, window_median
from spurline.operators.store import keep

#: Cells of an area that one network is solved for at most; larger areas are solved on means of blocks.
MOST_CELLS = 160_000
_BODY = "place long, tr int, tc int, size int, body binary"


class _Open:
    """A piece of the network with its inner cells eliminated: the equations a x = b of those cells that touch others, and how inner cells follow from them.

    ids: cells, row * 2^32 + col, in order. right, down: their conductances to the next cells, wanted when pieces meet.
    """

    def __init__(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, right: np.ndarray, down: np.ndarray) -> None:
        self.ids, self.a, self.b, self.right, self.down = ids, a, b, right, down

    def eliminated(self, stays: np.ndarray) -> tuple[_Open, tuple]:
        """The equations of the cells that stay, and what gives the others: their ids, and x = base - by @ x of those that stay."""
        goes = ~stays
        both = np.linalg.solve(self.a[np.ix_(goes, goes)], np.column_stack([self.a[np.ix_(goes, stays)], self.b[goes]])) if goes.any() else np.zeros((0, int(stays.sum()) + 1))
        by, base = both[:, :-1], both[:, -1]
        across = self.a[np.ix_(stays, goes)]
        left = _Open(self.ids[stays], self.a[np.ix_(stays, stays)] - across @ by, self.b[stays] - across @ base, self.right[stays], self.down[stays])
        return left, (self.ids[goes], base, by, self.ids[stays])


_ROW = 1 << 32


def _joined(pieces: list[_Open]) -> _Open:
    """Pieces side by side as one, with the conductances between their cells."""
    ids = np.concatenate([p.ids for p in pieces])
    n, at = len(ids), 0
    a, of = np.zeros((n, n)), np.repeat(np.arange(len(pieces)), [len(p.ids) for p in pieces])
    for p in pieces:
        a[at : at + len(p.ids), at : at + len(p.ids)] = p.a
        at += len(p.ids)
    right, down = np.concatenate([p.right for p in pieces]), np.concatenate([p.down for p in pieces])
    order = np.argsort(ids)
    for g, step in ((right, 1), (down, _ROW)):
        found = np.minimum(np.searchsorted(ids[order], ids + step), n - 1)
        other = order[found]
        meet = np.flatnonzero((ids[other] == ids + step) & (of[other] != of))
        a[meet, other[meet]] -= g[meet]
        a[other[meet], meet] -= g[meet]
    return _Open(ids, a, np.concatenate([p.b for p in pieces]), right, down)


def _leaf(cells: pd.DataFrame, axis: int) -> _Open:
    """The equations of the cells of a square whose potential isn't fixed: those of the first row (or column) are at 1, of the last at 0."""
    row, col = cells["row"].to_numpy(dtype=np.int64), cells["col"].to_numpy(dtype=np.int64)
    g = {k: cells[k].fillna(0).to_numpy(dtype=float) for k in ("left", "right", "up", "down")}
    at, last = (row, int(cells["height"].iloc[0]) - 1) if axis == 0 else (col, int(cells["width"].iloc[0]) - 1)
    before, after = (g["up"], g["down"]) if axis == 0 else (g["left"], g["right"])
    free = (at > 0) & (at < last)
    order = np.flatnonzero(free)[np.argsort(row[free] * _ROW + col[free])]
    ids = row[order] * _ROW + col[order]
    a = np.diag(sum(g.values())[order])
    for k, step in (("right", 1), ("down", _ROW)):
        found = np.minimum(np.searchsorted(ids, ids + step), max(len(ids) - 1, 0))
        meet = np.flatnonzero(ids[found] == ids + step) if len(ids) else np.empty(0, dtype=int)
        a[meet, found[meet]] = a[found[meet], meet] = -g[k][order][meet]
    # what flows in from fixed cells: those of the first row at 1
    b = np.where(at[order] == 1, before[order], 0.0)
    return _Open(ids, a, b, g["right"][order], g["down"][order])


def _touching(ids: np.ndarray, low: tuple[int, int], high: tuple[int, int], height: int, width: int, axis: int) -> np.ndarray:
    """Which cells have a free neighbour outside the rectangle from low to high."""
    row, col = ids // _ROW, ids % _ROW
    rows = (1, height - 2) if axis == 0 else (0, height - 1)
    cols = (0, width - 1) if axis == 0 else (1, width - 2)
    return ((row == low[0]) & (row > rows[0])) | ((row == high[0]) & (row < rows[1])) | ((col == low[1]) & (col > cols[0])) | ((col == high[1]) & (col < cols[1]))


def potentials(df: DataFrame, resistance: str, by: Sequence[str] = (), tile: int = 32) -> DataFrame:
    """by, row, col, ns and we: the potential of each cell when the first row (column) of its area is held at 1 and the last at 0.

    Neighbouring cells conduct 2 / (the sum of their resistances). Every square of `tile` cells eliminates its inner cells; four squares at a time then meet, and eliminate what no longer touches others, until an area is one; and
    the potentials go back down the same tree. So it is an exact solution whatever the resistances, in as many rounds as the logarithm of squares across, and a task holds the cells on the border of
    its piece, squared: 4 n by 4 n numbers for an area of n by n cells. An area of fewer than two rows or columns has potentials of fixed cells alone.
    """
    r = F.col(resistance).cast("double")
    along, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")
    g = lambda other: 2.0 / (r + other)
    cells = df.select(*by, "row", "col", r.alias(resistance)).withColumns({
        "left": g(F.lag(resistance).over(along)), "right": g(F.lead(resistance).over(along)), "up": g(F.lag(resistance).over(down)), "down": g(F.lead(resistance).over(down)),
    })
    sizes = df.groupBy(*by).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    # an area is a number, so that pieces need not know its columns
    areas = keep(sizes.withColumn("place", F.xxhash64(*by) if by else F.lit(0).cast("long")))
    sized = cells.join(F.broadcast(areas), list(by)) if by else cells.crossJoin(F.broadcast(areas))
    leaves = keep(sized.withColumns({"tr": tile_of(F.col("row"), tile), "tc": tile_of(F.col("col"), tile)}).select("place", "height", "width", "row", "col", "tr", "tc", "left", "right", "up", "down"))
    most = leaves.agg(F.max(F.greatest("tr", "tc"))).first()[0] or 0  # none without cells

    def leaf(part: pd.DataFrame) -> pd.DataFrame:
        h, w = int(part["height"].iloc[0]), int(part["width"].iloc[0])
        low, high = (part["row"].min(), part["col"].min()), (part["row"].max(), part["col"].max())
        body = []
        for axis in (0, 1):
            piece = _leaf(part, axis)
            body.append(piece.eliminated(_touching(piece.ids, low, high, h, w, axis))[0])
        return _piece(part, low, high, h, w, body)

    def _piece(part: pd.DataFrame, low, high, h: int, w: int, body: object) -> pd.DataFrame:
        return pd.DataFrame({"place": [part["place"].iloc[0]], "tr": [int(part["tr"].iloc[0])], "tc": [int(part["tc"].iloc[0])], "size": [0], "body": [pickle.dumps((tuple(map(int, low)), tuple(map(int, high)), h, w, body))]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        held = [pickle.loads(b) for b in parts.sort_values(["or", "oc"])["body"]]
        low, high = tuple(min(x[0][i] for x in held) for i in (0, 1)), tuple(max(x[1][i] for x in held) for i in (0, 1))
        h, w = held[0][2:4]
        open_, back = [], []
        for axis in (0, 1):
            whole = _joined([x[4][axis] for x in held])
            left, inside = whole.eliminated(_touching(whole.ids, low, high, h, w, axis))
            open_.append(left)
            back.append(inside)
        up = _piece(parts, low, high, h, w, open_)
        # what gives the potentials of the eliminated cells is kept for the way back
        return pd.concat([up, _piece(parts, low, high, h, w, back).assign(size=1)])

    level, backs = keep(leaves.groupBy("place", "tr", "tc").applyInPandas(leaf, _BODY)), []
    across = most + 1
    while across > 1:
        halved = level.select("place", F.col("tr").alias("or"), F.col("tc").alias("oc"), F.floor(F.col("tr") / 2).cast("int").alias("tr"), F.floor(F.col("tc") / 2).cast("int").alias("tc"), "body")
        both = keep(halved.groupBy("place", "tr", "tc").applyInPandas(merged, _BODY))
        level, across = keep(both.where("size = 0")), -(-across // 2)
        backs.append(keep(both.where("size = 1")))

    def lowered(above: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Potentials of the cells a piece eliminated, from those of the piece above it; given on to four pieces below."""
        if own.empty:
            return pd.DataFrame({"place": [], "tr": [], "tc": [], "size": [], "body": []})
        back = pickle.loads(own["body"].iloc[0])[4]
        known = pickle.loads(above["body"].iloc[0]) if len(above) else [{}, {}]
        out = []
        for (ids, base, by_, stays), x in zip(back, known):
            given = np.array([x[i] for i in stays.tolist()])
            found = base - by_ @ given if len(stays) else base
            out.append({**dict(zip(stays.tolist(), given.tolist())), **dict(zip(ids.tolist(), found.tolist()))})
        tr, tc = int(own["tr"].iloc[0]), int(own["tc"].iloc[0])
        down_ = [(tr * 2 + i, tc * 2 + j) for i in (0, 1) for j in (0, 1)]
        return pd.DataFrame({"place": own["place"].iloc[0], "tr": [a for a, _ in down_], "tc": [b for _, b in down_], "size": 2, "body": pickle.dumps(out)})

    keys = ["place", "tr", "tc"]
    known = level.limit(0)
    for back in reversed(backs):
        known = keep(known.groupBy(*keys).cogroup(back.groupBy(*keys)).applyInPandas(lowered, _BODY))

    def solved(above: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({"place": [], "row": [], "col": [], "ns": [], "we": []})
        h, w = int(part["height"].iloc[0]), int(part["width"].iloc[0])
        x = pickle.loads(above["body"].iloc[0]) if len(above) else [{}, {}]
        low, high = (part["row"].min(), part["col"].min()), (part["row"].max(), part["col"].max())
        out = part[["place", "row", "col"]].copy()
        cell = part["row"].to_numpy(dtype=np.int64) * _ROW + part["col"].to_numpy(dtype=np.int64)
        for axis, name in ((0, "ns"), (1, "we")):
            piece = _leaf(part, axis)
            ids, base, by_, stays = piece.eliminated(_touching(piece.ids, low, high, h, w, axis))[1]
            given = np.array([x[axis][i] for i in stays.tolist()])
            value = {**dict(zip(stays.tolist(), given)), **dict(zip(ids.tolist(), base - by_ @ given if len(stays) else base))}
            first = part["row" if axis == 0 else "col"].to_numpy() == 0
            out[name] = [value.get(i, 1.0 if one else 0.0) for i, one in zip(cell.tolist(), first)]
        return out

    found = known.groupBy(*keys).cogroup(leaves.groupBy(*keys)).applyInPandas(solved, "place long, row int, col int, ns double, we double")
    return found.join(F.broadcast(areas.select("place", *by)), "place").select(*by, "row", "col", "ns", "we") if by else found.drop("place")


def current(df: DataFrame, resistance: str, by: Sequence[str] = (), tile: int = 32) -> DataFrame:
    """by, row, col and current: half the sum of the currents on a cell's four edges, relative to its area's mean, on the average of pushing it from north to south and from west to east. Resistances count as 1 to 10,000."""
    bounded = df.select(*by, "row", "col", F.least(F.greatest(F.col(resistance).cast("double"), F.lit(1.0)), F.lit(1e4)).alias("r_"))
    both = keep(bounded.join(potentials(bounded, "r_", by, tile), [*by, "row", "col"]))
    along, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")

    def through(v: str):
        edges = [F.coalesce(F.abs(2.0 / (F.col("r_") + move("r_").over(w)) * (F.col(v) - move(v).over(w))), F.lit(0.0)) for w in (along, down) for move in (F.lag, F.lead)]
        return 0.5 * sum(edges, F.lit(0.0))

    at = both.withColumn("a_", through("ns")).withColumn("b_", through("we"))
    means = keep(at.groupBy(*by).agg(F.greatest(F.avg("a_"), F.lit(1e-12)).alias("ma_"), F.greatest(F.avg("b_"), F.lit(1e-12)).alias("mb_")))  # a row for each area
    at = at.join(means, list(by)) if by else at.crossJoin(F.broadcast(means))
    return at.select(*by, "row", "col", (0.5 * (F.col("a_") / F.col("ma_") + F.col("b_") / F.col("mb_"))).alias("current"))


def funnels(df: DataFrame, resistance: str, cell: float, local: float = 600.0, by: Sequence[str] = (), tile: int = 32) -> DataFrame:
    """by, row, col and funnel, 0 to 1: how strongly movement is squeezed through a cell: log2 of its current against the median within the square of `local` metres about it, over 2.5."""
    half = max(3, round(local / cell) | 1) // 2
    here = keep(current(df, resistance, by, tile))
    usual = window_median(here, "current", half, "edge", by).withColumnRenamed("current", "usual_")
    ratio = F.col("current") / F.greatest("usual_", F.lit(1e-9))
    score = F.log2(F.greatest(ratio, F.lit(1e-9))) / 2.5
    return here.join(usual, [*by, "row", "col"]).select(*by, "row", "col", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("funnel"))


def coarse_funnels(df: DataFrame, resistance: str, cell: float, height: int, width: int, local: float = 600.0, by: Sequence[str] = (), most_cells: int = MOST_CELLS, tile: int = 32) -> DataFrame:
    """funnels() of areas of any size: over most_cells they are solved on means of square blocks and interpolated back."""
    factor = 1
    while -(-height // factor) * -(-width // factor) > most_cells:
        factor += 1
    if factor == 1:
        return funnels(df, resistance, cell, local, by, tile)
    small = blocks(df, factor, F.avg(resistance).alias(resistance), by=by).withColumnsRenamed({"block_row": "row", "block_col": "col"})
    found = funnels(small, resistance, cell * factor, local, by, tile).withColumnsRenamed({"row": "block_row", "col": "block_col"})
    return upsampled(found, "funnel", factor, height, width, by)

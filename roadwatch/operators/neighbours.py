"""Radius and nearest-neighbour operators on a hierarchical grid.

No operator here forms all pairs of a group. Equal coordinates are merged
first. Cells of side radius/√2 are then paired with their neighbours; a pair of
cells whose points are certainly all within the radius is answered from cell
totals, one that is certainly out of reach is dropped, and one that could go
either way is compared point by point only while it is small. Larger undecided
pairs are split into quarters and looked at again, so only the rim of the disc
is ever compared in detail, however many points a cell holds.

Tables that several steps read are stored, in as many parts as their size asks for: a cached
table keeps every shuffle partition, and each later shuffle would open partitions times
partitions files. Cells and pairs meet in sort-merge joins: they compress so well that a
million rows can pass for small and be built up in the driver to be broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from roadwatch import settings as S
from roadwatch.functions.geo import haversine_m, within_m
from roadwatch.session import cut_lineage

BITS = 20                # a cell can be halved this many times
PAIR_LIMIT = 65_536      # point comparisons allowed for one pair of cells
KEYS = ["world", "lat", "lon"]
SLACK = 1e-9


@dataclass(frozen=True)
class Grid:
    """Cells whose diagonal stays within the radius for latitudes lat_lo … lat_hi."""

    radius: float
    lat_lo: float
    lat_hi: float

    @staticmethod
    def fit(radius: float, *frames: DataFrame) -> "Grid":
        """Grid for the latitudes that occur (one small aggregate)."""
        bounds = [f.agg(F.min("lat"), F.max("lat")).first() for f in frames]
        lows, highs = [b[0] for b in bounds if b[0] is not None], [b[1] for b in bounds if b[1] is not None]
        return Grid(radius, min(lows, default=0.0), max(highs, default=0.0))

    @property
    def _cos(self) -> tuple[float, float]:
        near = 0.0 if self.lat_lo <= 0.0 <= self.lat_hi else min(abs(self.lat_lo), abs(self.lat_hi))
        far = max(abs(self.lat_lo), abs(self.lat_hi))
        if far > 85.0:
            raise ValueError("grid operators support latitudes up to 85 degrees")
        return math.cos(math.radians(far)), math.cos(math.radians(near))

    @property
    def side(self) -> float:
        return self.radius / math.sqrt(2.0) * (1 - 1e-6)

    @property
    def step(self) -> tuple[float, float]:
        """Cell height and width in degrees."""
        height = math.degrees(self.side / S.EARTH_RADIUS_M)
        return height, height / self._cos[1]

    def reach(self, radius: float | None = None) -> tuple[int, int]:
        """How many cells away a point within the radius can be."""
        lo, hi = self._cos
        n = (radius or self.radius) / self.side
        return math.floor(n) + 1, math.floor(n * hi / lo) + 1

    def index(self, df: DataFrame) -> DataFrame:
        """Add the finest cell indices; worlds are placed out of each other's reach."""
        height, width = self.step
        fine = float(2**BITS)
        return df.withColumns({
            "fy": F.floor((F.col("lat") + 90.0) / height * fine).cast("long") + F.shiftleft(F.col("world").cast("long"), BITS + 26),
            "fx": F.floor((F.col("lon") + 180.0) / width * fine).cast("long"),
        })

    def bounds(self, dy: Column, dx: Column, scale) -> tuple[Column, Column]:
        """Least and greatest distance between points of two cells (dy, dx) apart; ``scale`` is the cell size factor."""
        height, width = (math.radians(v) for v in self.step)
        cos_lo, cos_hi = self._cos

        def metres(ny, nx, cos):
            sy, sx = F.sin(ny * scale * (height / 2)), F.sin(nx * scale * (width / 2))
            return 2 * S.EARTH_RADIUS_M * F.asin(F.sqrt(F.least(sy * sy + (cos * cos) * sx * sx, F.lit(1.0))))

        ay, ax = F.abs(dy), F.abs(dx)
        zero = F.lit(0)
        return (metres(F.greatest(ay - 1, zero), F.greatest(ax - 1, zero), cos_lo) * (1 - SLACK),
                metres(ay + 1, ax + 1, cos_hi) * (1 + SLACK))


def _meet(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that never gathers a side in the driver."""
    return a.join(b.hint("merge"), on, how)


def cell(level: int, prefix: str = "") -> list[Column]:
    """Cell columns of an indexed table at a level (0 is coarsest)."""
    return [F.shiftright("fy", BITS - level).alias(f"{prefix}y"), F.shiftright("fx", BITS - level).alias(f"{prefix}x")]


def _cells(points: DataFrame, level: int, prefix: str, aggs: list[Column] = ()) -> DataFrame:
    return points.groupBy(*cell(level, prefix)).agg(F.count("*").alias(f"{prefix}n"), *aggs)


def _offsets(ry: int, rx: int, half: bool = False) -> Column:
    steps = [(y, x) for y in range(-ry, ry + 1) for x in range(-rx, rx + 1) if not half or (y, x) > (0, 0)]
    return F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in steps]))


def _start(q_cells: DataFrame, t_cells: DataFrame, grid: Grid, half: bool = False) -> DataFrame:
    near = q_cells.withColumn("o", _offsets(*grid.reach(), half=half))
    near = near.withColumns({"ty": F.col("qy") + F.col("o.dy"), "tx": F.col("qx") + F.col("o.dx")}).drop("o")
    return _meet(near, t_cells, ["ty", "tx"])


def _split(pairs: DataFrame, q_cells: DataFrame, t_cells: DataFrame) -> DataFrame:
    """Replace undecided pairs by the pairs of their quarters."""
    def below(cells, p):
        return cells.withColumns({f"{p}py": F.shiftright(f"{p}y", 1), f"{p}px": F.shiftright(f"{p}x", 1)})

    parents = pairs.select(F.col("qy").alias("qpy"), F.col("qx").alias("qpx"), F.col("ty").alias("tpy"), F.col("tx").alias("tpx"))
    return _meet(_meet(parents, below(q_cells, "q"), ["qpy", "qpx"]), below(t_cells, "t"), ["tpy", "tpx"]).drop("qpy", "qpx", "tpy", "tpx")


def _judged(pairs: DataFrame, grid: Grid, level: int, radius: float) -> DataFrame:
    lo, hi = grid.bounds(F.col("ty") - F.col("qy"), F.col("tx") - F.col("qx"), 0.5**level)
    return pairs.withColumns({"_lo": lo, "_hi": hi}).filter(F.col("_lo") <= radius)


def _hottest(cells: DataFrame, column: str) -> int:
    return cells.agg(F.max(column)).first()[0] or 0


def prepared(df: DataFrame, aggs: dict[str, Column], world: str | None = None) -> DataFrame:
    """Merge equal coordinates; ``aggs`` are the merged payload columns."""
    df = df.withColumn("world", F.col(world) if world else F.lit(0))
    return df.groupBy(*KEYS).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs else df.select(*KEYS).distinct()


def radius_totals(points: DataFrame, targets: DataFrame, radius: float, payload: dict[str, str], *,
                  strict: bool = False, limit: int = PAIR_LIMIT, grid: Grid | None = None) -> DataFrame:
    """Totals of target payload within ``radius`` of each point.

    ``points`` and ``targets`` are merged tables with (world, lat, lon); ``payload`` names
    target columns and how to combine them ('sum' or 'min'). Points without a
    target in reach are absent from the result.
    """
    how = {"sum": F.sum, "min": F.min}
    same = points is targets
    targets = cut_lineage(targets.select(*KEYS, *payload))
    points = targets.select(*KEYS) if same else cut_lineage(points.select(*KEYS))
    grid = grid or Grid.fit(radius, points, targets)
    q, t = grid.index(points), grid.index(targets)
    combine = [how[h](c).alias(c) for c, h in payload.items()]

    def near(a, b):
        return within_m(a["lat"], a["lon"], b["lat"], b["lon"], radius, strict)

    q_cells, t_cells = _cells(q, 0, "q"), _cells(t, 0, "t", combine)
    deep = _hottest(q_cells, "qn") * _hottest(t_cells, "tn") > limit
    pairs, level, parts = _judged(_start(q_cells, t_cells, grid), grid, 0, radius), 0, []
    while True:
        if deep:
            pairs = cut_lineage(pairs)
        whole = F.col("_hi") <= radius if not strict else F.col("_hi") < radius
        small = (F.col("qn") * F.col("tn") <= limit) if level < BITS else F.lit(True)
        covered = pairs.filter(whole).groupBy("qy", "qx").agg(*combine)
        parts.append(_meet(q.select(*KEYS, *cell(level, "q")), covered, ["qy", "qx"]).select(*KEYS, *payload))
        rim = pairs.filter(~whole & small).select("qy", "qx", "ty", "tx")
        a = _meet(q.select(*KEYS, *cell(level, "q")), rim, ["qy", "qx"]).alias("a")
        b = t.select(*KEYS, *payload, *cell(level, "t")).alias("b")
        met = _meet(a, b, (F.col("a.ty") == F.col("b.ty")) & (F.col("a.tx") == F.col("b.tx")))
        met = met.filter(near({k: F.col(f"a.{k}") for k in KEYS}, {k: F.col(f"b.{k}") for k in KEYS}))
        parts.append(met.select(*[F.col(f"a.{k}").alias(k) for k in KEYS], *payload))
        if not deep:
            break
        rest = pairs.filter(~whole & ~small)
        if rest.isEmpty():
            break
        level += 1
        pairs = _judged(_split(rest, _cells(q, level, "q"), _cells(t, level, "t", combine)), grid, level, radius)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*KEYS).agg(*combine)


def linked_cells(points: DataFrame, grid: Grid, limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs (a, b) of level-0 cells that hold two points within the grid radius.

    A cell pair is settled by its first quarter pair that must touch; only
    pairs still open are split further.
    """
    radius = grid.radius
    p = grid.index(cut_lineage(points.select(*KEYS)))
    cells = _cells(p, 0, "q")
    t_cells = cells.toDF("ty", "tx", "tn")
    deep = _hottest(cells, "qn") ** 2 > limit
    pairs, level, found = _judged(_start(cells, t_cells, grid, half=True), grid, 0, radius), 0, []

    def roots(df, level):
        return df.select(*[F.shiftright(c, level).alias(f"r{c}") for c in ("qy", "qx", "ty", "tx")])

    while True:
        if deep:
            pairs = cut_lineage(pairs)
        whole = F.col("_hi") <= radius
        small = (F.col("qn") * F.col("tn") <= limit) if level < BITS else F.lit(True)
        found.append(roots(pairs.filter(whole), level))
        rim = pairs.filter(~whole & small).select("qy", "qx", "ty", "tx")
        a = _meet(p.select(*KEYS, *cell(level, "q")), rim, ["qy", "qx"]).alias("a")
        b = p.select(*KEYS, *cell(level, "t")).alias("b")
        met = _meet(a, b, (F.col("a.ty") == F.col("b.ty")) & (F.col("a.tx") == F.col("b.tx")))
        met = met.filter(within_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), radius))
        found.append(roots(met.select("qy", "qx", "a.ty", "a.tx"), level))
        if not deep:
            break
        settled = found[0]
        for f in found[1:]:
            settled = settled.unionByName(f)
        settled = cut_lineage(settled.distinct())
        found = [settled]
        open_pairs = pairs.filter(~whole & ~small)
        open_pairs = open_pairs.join(roots(open_pairs, level).distinct().join(settled, settled.columns, "left_anti"), [
            F.shiftright(open_pairs[c], level) == F.col(f"r{c}") for c in ("qy", "qx", "ty", "tx")], "left_semi")
        if open_pairs.isEmpty():
            break
        level += 1
        pairs = _judged(_split(open_pairs, _cells(p, level, "q"), _cells(p, level, "t")), grid, level, radius)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct().select(node("rqy", "rqx").alias("a"), node("rty", "rtx").alias("b"))


def node(y, x) -> Column:
    """One number for a level-0 cell."""
    return F.shiftleft(F.col(y), 27) + F.col(x)


# -------------------------------------------------------------------- features
def _per_row(df: DataFrame, totals: DataFrame, columns: list[str]) -> DataFrame:
    """Bring per-coordinate totals back to the rows (one row per coordinate on the right)."""
    joined = df.withColumn("world", F.lit(0)).join(totals, KEYS, "left").drop("world")
    return joined.fillna(0, columns)


def nearby_closure_share(sp: DataFrame, radius: float = S.EPS_METRES) -> DataFrame:
    """Closures within the radius ÷ all closures, per row (a closure counts itself)."""
    closures = cut_lineage(prepared(sp.filter("closure = 1"), {"closures": F.count("*")}))
    total = closures.agg(F.sum("closures")).scalar()
    near = radius_totals(prepared(sp, {}), closures, radius, {"closures": "sum"})
    share = F.col("closures") / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1))
    return _per_row(sp, near, ["closures"]).withColumn("historical_nearby_closure_rate", share)


def nearby_closure_rate(df: DataFrame, radius: float = S.EPS_METRES, exclude_self: bool = False) -> DataFrame:
    """Mean closure flag of the rows within the radius, the row included.

    With ``exclude_self`` the row's own label is left out (null without neighbours).
    """
    cells = prepared(df, {"n": F.count("*"), "closures": F.sum("closure")})
    near = radius_totals(cells, cells, radius, {"n": "sum", "closures": "sum"})
    own = F.lit(1 if exclude_self else 0)
    mine = F.col("closure") if exclude_self else F.lit(0)
    rate = (F.col("closures") - mine) / F.nullif(F.col("n") - own, F.lit(0))
    return _per_row(df, near, ["n", "closures"]).withColumn("nearby_closure_rate", rate).drop("n", "closures")


def nearby_fold_counts(df: DataFrame, label: str, folds: int, n: str, s: str, radius: float = S.EPS_METRES, fold: str = "fold") -> DataFrame:
    """Add arrays ``n`` and ``s`` with the number of rows and the sum of ``label`` within the radius, one entry per fold of
    the neighbour. All folds come from one pass over the grid; who must not see a fold leaves its entry out."""
    one = {f"_n{f}": F.count_if(F.col(fold) == f) for f in range(folds)}
    sums = {f"_s{f}": F.coalesce(F.sum(F.when(F.col(fold) == f, F.col(label))), F.lit(0)) for f in range(folds)}
    cells = prepared(df, one | sums)
    near = radius_totals(cells, cells, radius, dict.fromkeys([*one, *sums], "sum"))
    return _per_row(df, near, [*one, *sums]).withColumns({n: F.array(*one), s: F.array(*sums)}).drop(*one, *sums)


def neighbour_counts(df: DataFrame, radius: float = S.EPS_METRES) -> DataFrame:
    """Rows within the radius of each row, itself included."""
    cells = prepared(df, {"neighbours": F.count("*")})
    return _per_row(df, radius_totals(cells, cells, radius, {"neighbours": "sum"}), ["neighbours"])


def blocked_nodes(nodes: DataFrame, incidents: DataFrame, radius: float = S.BLOCK_RADIUS_M) -> DataFrame:
    """Nodes nearer than the radius to the middle of an incident stretch."""
    middles = incidents.filter(F.col("has_end_coord")).select(
        ((F.col("lat") + F.col("end_lat")) / 2).alias("lat"), ((F.col("lon") + F.col("end_lon")) / 2).alias("lon"))
    hit = radius_totals(prepared(nodes, {}), prepared(middles, {"n": F.count("*")}), radius, {"n": "sum"}, strict=True)
    return nodes.join(hit.select("lat", "lon"), ["lat", "lon"], "left_semi")


def open_edges(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges (u, v) that touch no blocked node."""
    ids = blocked.select("node")
    return (edges.join(ids, edges.u == ids.node, "left_anti")
            .join(ids.withColumnRenamed("node", "_n"), F.col("v") == F.col("_n"), "left_anti"))


# --------------------------------------------------------------------- nearest
def nearest_distance(points: DataFrame, targets: DataFrame, finest_m: float = 0.1, limit: int = 4096) -> DataFrame:
    """Distance from each point to its nearest target, exact, as (world, lat, lon, distance_m).

    Every point first finds the finest level at which an occupied cell touches its own
    cell. Candidates around it are pruned with distance bounds and refined level by
    level until a point has few of them left.
    """
    q, t = cut_lineage(prepared(points, {})), cut_lineage(prepared(targets, {}))
    grid = Grid.fit(finest_m, q, t)
    extent = q.unionByName(t).agg(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).first()
    height, width = grid.step
    top = max(1, math.ceil(math.log2(max((extent[0] or 0) / height, (extent[1] or 0) / width, 2.0))) + 1)
    q, t = _base_cells(grid, q), _base_cells(grid, t)

    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))

    def at_level(df):
        return df.withColumn("level", levels).withColumns(
            {"y": F.expr("shiftright(by, level)"), "x": F.expr("shiftright(bx, level)")})

    cells = cut_lineage(at_level(t).groupBy("level", "y", "x").agg(F.count("*").alias("n")))

    def around(df, r):
        df = df.withColumn("o", _offsets(r, r))
        return df.withColumns({"y": F.col("y") + F.col("o.dy"), "x": F.col("x") + F.col("o.dx")}).drop("o")

    # occupied surroundings are looked up once per cell and level, not once per point
    probes = at_level(q).select("level", "y", "x").distinct().withColumns({"py": F.col("y"), "px": F.col("x")})
    touched = _meet(around(probes, 1), cells, ["level", "y", "x"]).select(
        "level", F.col("py").alias("y"), F.col("px").alias("x")).distinct()
    found = _meet(at_level(q), touched, ["level", "y", "x"]).groupBy(*KEYS, "by", "bx").agg(F.min("level").alias("level"))
    start = found.withColumns({"y": F.expr("shiftright(by, level)"), "x": F.expr("shiftright(bx, level)")})
    cand = _pruned(_meet(around(start, 3), cells, ["level", "y", "x"]), grid)
    while True:
        cand = cut_lineage(cand)
        load = cand.groupBy(*KEYS).agg(F.sum("n").alias("load"), F.max("level").alias("at"))
        busy = load.filter((F.col("load") > limit) & (F.col("at") > 0))
        if busy.isEmpty():
            break
        grow = _meet(cand, busy.select(*KEYS), KEYS, "left_semi")
        keep = _meet(cand, busy.select(*KEYS), KEYS, "left_anti")
        parts = cells.select((F.col("level") + 1).alias("level"), F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"),
                             F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("n").alias("cn"))
        finer = _meet(grow.drop("n"), parts, ["level", "y", "x"]).select(
            *KEYS, "by", "bx", (F.col("level") - 1).alias("level"), F.col("cy").alias("y"), F.col("cx").alias("x"), F.col("cn").alias("n"))
        cand = keep.unionByName(_pruned(finer, grid))
    used = [r[0] for r in cand.select("level").distinct().collect()]   # at most `top` small numbers
    spread = t.withColumn("level", F.explode(F.array(*[F.lit(v) for v in used] or [F.lit(0)])))
    spread = spread.withColumns({"y": F.expr("shiftright(by, level)"), "x": F.expr("shiftright(bx, level)")}).select(
        "level", "y", "x", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))
    return _meet(cand, spread, ["level", "y", "x"]).groupBy(*KEYS).agg(F.min(d).alias("distance_m"))


def _base_cells(grid: Grid, df: DataFrame) -> DataFrame:
    indexed = grid.index(df)
    return indexed.select(*df.columns, F.shiftright("fy", BITS).alias("by"), F.shiftright("fx", BITS).alias("bx"))


def _pruned(cand: DataFrame, grid: Grid) -> DataFrame:
    """Drop candidate cells that cannot hold the nearest target."""
    size = F.pow(F.lit(2.0), F.col("level"))
    dy = F.col("y") - F.expr("shiftright(by, level)")
    dx = F.col("x") - F.expr("shiftright(bx, level)")
    lo, hi = grid.bounds(dy, dx, size)
    cand = cand.withColumns({"_lo": lo, "_hi": hi})
    best = cand.groupBy(*KEYS).agg(F.min("_hi").alias("_best"))
    return _meet(cand, best, KEYS).filter(F.col("_lo") <= F.col("_best")).drop("_lo", "_hi", "_best")

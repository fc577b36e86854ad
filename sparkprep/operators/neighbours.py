"""Neighbour-based operators: nearest neighbours in blocks, their vote, local outlier factor, DBSCAN, isolation forest.

Rows lie in blocks around pivots. A query goes to the blocks that the triangle inequality
does not rule out for it, a task holds one block and its queries, and only the k
best of a block leave it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.functions.components import components
from sparkprep.functions.tables import durable, spread
from sparkprep.operators.encode import fit_scaler, scale


def _vectors(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


#: Most pivots: their vectors and cells' radii are all that every task gets.
MOST_PIVOTS = 4096
#: Decimals at which squares of distances between scaled features are compared: scaling leaves noise beyond, which would order rows that are equally far.
TIE_DIGITS = 12


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """n rows by digest of their ids, different ones."""
    some = rows.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r["v"] for r in some], dtype=float)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to all pivots, by differences so that small ones keep their digits."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], axis=1))


def _celled(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v) with the nearest pivot's number and distance."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            cell, dist = [np.zeros(0, dtype=np.int32)], [np.zeros(0)]
            for at in range(0, len(v), 1024):
                d = _to_pivots(np.stack(v.iloc[at : at + 1024].to_numpy()), shared.value)
                cell.append(d.argmin(1).astype(np.int32))
                dist.append(d.min(1))
            yield pd.DataFrame({"cell": np.concatenate(cell), "far": np.concatenate(dist)})

    return df.withColumn("_c", F.pandas_udf(run, "cell int, far double")(F.col("v"))).select("id", "v", "_c.cell", "_c.far")


def _best_of(rows: DataFrame, asking: DataFrame, k: int, exclude_self: bool, block: int, digits: int | None) -> DataFrame:
    """(query, id, distance, far): the k best of each block, by far and id, for every query that comes to it. Both have the block, (cell, part); a block that many queries come to is dealt.

    far is the distance, or with digits its square in whole units of the last digit.
    """
    shares = asking.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("shares"))
    left = rows.select("id", "v", "cell", "part").join(shares, ["cell", "part"]).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))).withColumn("q", F.lit(False))
    right = asking.select("id", "v", "cell", "part").join(shares, ["cell", "part"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).withColumn("q", F.lit(True))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[~pdf["q"]], pdf[pdf["q"]]
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "id": [], "distance": [], "far": []}).astype({"query": "int64", "id": "int64", "distance": "float64", "far": "float64"})
        av, bv, ai, bi = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy()), a["id"].to_numpy(), b["id"].to_numpy()
        out, a2, b2 = [], (av**2).sum(1), (bv**2).sum(1)
        # what rounding may add to the difference of two of the squares below, and what one far may hold
        slack = (4 * av.shape[1] + 6) * np.finfo(float).eps * (a2.max() + b2) + (0.0 if digits is None else 10.0**-digits)
        for at in range(0, len(bv), 256):
            d2 = np.maximum(0, b2[at : at + 256, None] + a2[None, :] - 2 * bv[at : at + 256] @ av.T)
            for i, row in enumerate(d2):
                if exclude_self:
                    row[ai == bi[at + i]] = np.inf
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[at + i]) if len(row) > k else np.arange(len(row))
                near = near[np.isfinite(row[near])]
                square = ((av[near] - bv[at + i]) ** 2).sum(1)
                exact = np.sqrt(square)
                far = exact if digits is None else np.floor(square * 10.0**digits + 0.5)
                best = np.lexsort((ai[near], far))[:k]
                out.append((np.full(len(best), bi[at + i]), ai[near[best]], exact[best], far[best]))
        return pd.DataFrame({c: np.concatenate([o[x] for o in out]) for x, c in enumerate(("query", "id", "distance", "far"))})

    columns = ["cell", "part", "share", "id", "v", "q"]
    return left.select(*columns).unionByName(right.select(*columns)).groupBy("cell", "part", "share").applyInPandas(meet, "query long, id long, distance double, far double")


def _visits(asking: DataFrame, bounds: DataFrame, pivots: np.ndarray, radii: dict[int, float], parts: dict[int, int]) -> DataFrame:
    """The blocks, but its first, that a query's bound does not rule out: (id, v, cell, part).

    ``bounds`` has a query's k-th best distance so far. No row of a cell is nearer than the distance to the
    cell's pivot less the cell's radius; a cell is left out only where that is beyond the bound.
    """
    shared = asking.sparkSession.sparkContext.broadcast((pivots, radii, parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, radii, parts = shared.value
        cells = np.array(sorted(radii))
        reach = np.array([radii[c] for c in cells])
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                d = _to_pivots(np.stack(some["v"].to_numpy()), pivots[cells])
                bound = some["bound"].fillna(np.inf).to_numpy()[:, None]
                open_ = d - reach <= bound + 1e-9 * (1 + d + reach)
                q, c = np.nonzero(open_)
                n = np.array([parts[x] for x in cells[c]], dtype=int)
                q, cell = np.repeat(q, n), np.repeat(cells[c], n)
                part = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                again = (cell == some["cell"].to_numpy()[q]) & (part == some["part"].to_numpy()[q])
                q, cell, part = q[~again], cell[~again], part[~again]
                yield pd.DataFrame({"id": some["id"].to_numpy()[q], "v": list(some["v"].to_numpy()[q]), "cell": cell.astype(np.int32), "part": part.astype(np.int32)})

    known = asking.join(bounds.select(F.col("query").alias("id"), "bound"), "id", "left").select("id", "v", "cell", "part", "bound")
    return known.mapInPandas(run, "id long, v array<double>, cell int, part int")


def nearest(rows: DataFrame, queries: DataFrame, key: str, features: list[str], k: int, exclude_self: bool = False, block: int = 4096, digits: int | None = None) -> DataFrame:
    """(query, place, id, distance): the k nearest rows of every query by Euclidean distance, ties by id; exact.

    With digits, distances are ties where their squares agree when rounded to so many decimals.
    Rows lie in cells around pivots, at most MOST_PIVOTS of them, and large cells in parts, so each row is in one
    block of about ``block`` rows. A query looks at one block of its own cell first; its k-th best distance
    there rules out, by the triangle inequality, most other cells for it, and it goes to those that are left.
    """
    r, q = spread(_vectors(rows, key, features)), spread(_vectors(queries, key, features))
    n = r.count()
    if not n:
        return r.select(F.col("id").alias("query"), F.lit(1).alias("place"), "id", F.lit(0.0).alias("distance")).limit(0)
    pivots = _pivots(r, min(MOST_PIVOTS, max(1, n // block)))
    dealt = _celled(r, pivots)
    sizes = {s["cell"]: (s["n"], s["far"]) for s in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # a row a pivot
    parts = {c: -(-m // (2 * block)) for c, (m, _) in sizes.items()}
    of_cell = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("cell"))
    part = F.pmod(F.xxhash64("id"), of_cell).cast("int")
    dealt = durable(dealt.withColumn("part", part))
    asking = durable(_celled(q, pivots).where(F.col("cell").isin(list(parts))).withColumn("part", part))
    found = _best_of(dealt, asking, k, exclude_self, block, digits)
    if sum(parts.values()) > 1:
        found = durable(found)
        bound = F.max("distance") if digits is None else F.sqrt(F.pow(F.max("distance"), 2) + 10.0**-digits)  # a tie may lie a little farther
        bounds = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, bound).alias("bound"))
        visits = durable(_visits(asking, bounds, pivots, {c: far for c, (_, far) in sizes.items()}, parts))
        found = found.unionByName(_best_of(dealt, visits, k, exclude_self, block, digits))
    place = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "place", "id", "distance")


def _scaled(train: DataFrame, features: list[str], *others: DataFrame) -> tuple[DataFrame, ...]:
    """All frames with the features centred and scaled by the training rows."""
    fitted = fit_scaler(train, features)
    return tuple(scale(t, fitted) for t in (train, *others))


def knn_predict(train: DataFrame, df: DataFrame, key: str, features: list[str], label: str, k: int = 15, weights: str = "uniform", classify: bool = True, scaled: bool = True) -> DataFrame:
    """(key, prediction): the neighbours' vote (ties to the smaller label) or their mean. Distances are between scaled features."""
    if scaled:
        train, df = _scaled(train, features, df)
    near = nearest(train, df, key, features, k, digits=TIE_DIGITS if scaled else None).join(train.select(F.col(key).cast("long").alias("id"), F.col(label).alias("_y")), "id")
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest("distance", F.lit(1e-12))
    if not classify:
        return near.groupBy(F.col("query").alias(key)).agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("prediction"))
    votes = near.groupBy("query", "_y").agg(F.sum(w).alias("w"))
    best = Window.partitionBy("query").orderBy(F.desc("w"), "_y")
    return votes.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("query").alias(key), F.col("_y").alias("prediction"))


def local_outlier_factor(train: DataFrame, df: DataFrame, key: str, features: list[str], k: int = 20, scaled: bool = True) -> DataFrame:
    """(key, lof) of new rows against the training rows: mean reachability density of the neighbours over the row's own. Distances are between scaled features."""
    if scaled:
        train, df = _scaled(train, features, df)
    digits = TIE_DIGITS if scaled else None
    own = durable(nearest(train, train, key, features, k, exclude_self=True, digits=digits))
    reach_k = own.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("kd"))
    density = own.join(reach_k, "id").groupBy(F.col("query").alias("id")).agg((1 / F.greatest(F.avg(F.greatest("distance", "kd")), F.lit(1e-12))).alias("lrd"))
    near = nearest(train, df, key, features, k, digits=digits).join(reach_k, "id").join(density, "id")
    return near.groupBy(F.col("query").alias(key)).agg((F.avg("lrd") * F.greatest(F.avg(F.greatest("distance", "kd")), F.lit(1e-12))).alias("lof"))


#: Cells of a side from whose corner to corner is eps are used up to so many features; with more there are too many cells next to one.
MOST_CELL_FEATURES = 4
#: Rows of a cell that one task compares with others'.
CELL_BLOCK = 4096


def _distance_within(eps: float) -> Column:
    square = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return square <= eps * eps


def _near_core(thin: DataFrame, pairs: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """(id, cell, other, near): rows of thin cells with the points within eps in the cells next to theirs. Large cells are dealt in parts."""
    asked = thin.join(pairs, "cell").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("id", "v", "cell", "other", "part")
    there = points.select(F.col("cell").alias("other"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("near"), F.col("v").alias("w"))
    return asked.join(there, ["other", "part"]).where(_distance_within(eps)).select("id", "cell", "other", "near")


def _box_distances(dims: int) -> tuple[Column, Column]:
    """Squares of the least and greatest distance between boxes (lo, hi) and (lo2, hi2)."""
    least, most = F.lit(0.0), F.lit(0.0)
    for i in range(dims):
        gap = F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("hi2")[i], F.col("lo2")[i] - F.col("hi")[i])
        span = F.greatest(F.col("hi")[i] - F.col("lo2")[i], F.col("hi2")[i] - F.col("lo")[i])
        least, most = least + gap * gap, most + span * span
    return least, most


def _full_links(full: DataFrame, pairs: DataFrame, eps: float, side: float, dims: int) -> DataFrame:
    """(cell, other) of full cells that have points within eps of each other, told by boxes around points, halved until all pairs are decided; no pairs of points are made."""
    least, most = _box_distances(dims)
    linked = None
    open_pairs = pairs.where("cell < other").select("cell", "other", F.lit("").alias("sub"), F.lit("").alias("sub2"))
    level = 0
    while True:
        # a box's name is its place among the halved cells, after its parent's
        places = [F.expr(f"array_join(transform(v, x -> cast(pmod(floor(x / {side / 2**k!r}D), 2) AS string)), '')") for k in range(1, level + 1)]
        named = full.withColumn("sub", F.concat(*places) if places else F.lit(""))
        ends = lambda f: F.array(*[f(F.col("v")[i]) for i in range(dims)])
        boxes = durable(named.groupBy("cell", "sub").agg(ends(F.min).alias("lo"), ends(F.max).alias("hi")))
        parent = F.expr(f"left(sub, length(sub) - {dims})") if level else F.lit("")
        mine = boxes.withColumn("parent", parent)
        yours = boxes.select(F.col("cell").alias("other"), F.col("sub").alias("sub2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")).withColumn("parent2", F.expr(f"left(sub2, length(sub2) - {dims})") if level else F.lit(""))
        asked = open_pairs.withColumnsRenamed({"sub": "parent", "sub2": "parent2"})
        met = durable(asked.join(mine, ["cell", "parent"]).join(yours, ["other", "parent2"]).withColumns({"least": least, "most": most}).where(F.col("least") <= eps * eps).select("cell", "other", "sub", "sub2", "least", "most"))
        sure = met.where((F.col("most") <= eps * eps) | (F.col("least") == F.col("most"))).select("cell", "other").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        linked = durable(linked)
        open_pairs = durable(met.join(linked.distinct(), ["cell", "other"], "left_anti").select("cell", "other", "sub", "sub2"))
        if open_pairs.isEmpty():
            return linked
        level += 1


def dbscan(df: DataFrame, key: str, features: list[str], eps: float = 0.5, min_samples: int = 5, scaled: bool = True) -> DataFrame:
    """(key, cluster): cluster is the smallest key among its core rows, noise -1; a border row joins its smallest core neighbour's cluster.

    Cells have a side of eps / sqrt(features), so all rows of a cell are within eps of each other: in a full cell, of
    min_samples rows or more, all are core without a look at pairs, and only rows of thin cells meet rows of the
    cells next to theirs. Cells are linked where core rows of two are within eps, two full ones by the boxes of
    their rows; clusters are the components of cells. With more than MOST_CELL_FEATURES features rows meet in cells of
    side eps. Distances are between scaled features.
    """
    if scaled:
        (df,) = _scaled(df, features)
    dims = len(features)
    if dims > MOST_CELL_FEATURES:
        return _dbscan_by_links(df, key, features, eps, min_samples)
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    base = _vectors(df, key, features).withColumn("place", F.transform("v", lambda x: F.floor(x / side).cast("long")))
    base = durable(base.withColumn("cell", F.md5(F.array_join(F.transform("place", lambda x: x.cast("string")), ","))))
    sizes = base.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.any_value("place").alias("place"))
    sizes = durable(sizes.withColumn("parts", F.ceil(F.col("n") / CELL_BLOCK).cast("int")))
    width = math.ceil(math.sqrt(dims))
    steps = [s for s in itertools.product(range(-width, width + 1), repeat=dims) if sum(max(0, abs(x) - 1) ** 2 for x in s) <= dims]
    spread = sizes.withColumn("_s", F.explode(F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in steps])))
    spread = spread.select("cell", F.col("n").alias("own"), F.zip_with("place", "_s", lambda c, s: c + s).alias("_to"))
    pairs = durable(spread.join(sizes.select(F.col("place").alias("_to"), F.col("cell").alias("other"), "n", "parts"), "_to").select("cell", "own", "other", "n", "parts"))
    points = base.select("id", "v", "cell").join(sizes.select("cell", "n", "parts"), "cell")
    thin, full = durable(points.where(F.col("n") < min_samples)), points.where(F.col("n") >= min_samples)
    around = pairs.where(F.col("own") < min_samples).select("cell", "other", "parts")
    enough = durable(_near_core(thin.select("id", "v", "cell"), around, points, eps).groupBy("id").agg(F.count(F.lit(1)).alias("near")).where(F.col("near") >= min_samples).select("id"))
    core = durable(full.select("id", "v", "cell", "parts").unionByName(thin.join(enough, "id").select("id", "v", "cell", "parts")))
    near = durable(_near_core(thin.select("id", "v", "cell"), around, core, eps).groupBy("id", "cell").agg(F.min("near").alias("first"), F.collect_set("other").alias("others")))  # as many cells as lie around one
    mine = near.join(enough, "id").select("cell", F.explode("others").alias("other"))
    between = pairs.where((F.col("own") >= min_samples) & (F.col("n") >= min_samples)).select("cell", "other")
    links = mine.unionByName(_full_links(full.select("v", "cell"), between, eps, side, dims)).select(F.col("cell").alias("a"), F.col("other").alias("b"))
    named = core.select("id", "cell").join(components(links).withColumnRenamed("node", "cell"), "cell", "left").select("id", F.coalesce("component", "cell").alias("component"))
    label = durable(named.join(named.groupBy("component").agg(F.min("id").alias("label")), "component").select("id", "label"))
    border = near.join(label.select("id"), "id", "left_anti").select("id", "first").join(label.toDF("first", "edge"), "first").select("id", "edge")
    out = base.select("id").join(label, "id", "left").join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("label", "edge", F.lit(-1)).alias("cluster"))


def _dbscan_by_links(df: DataFrame, key: str, features: list[str], eps: float, min_samples: int) -> DataFrame:
    """Core rows' links as such, met in cells of side eps."""
    dims = len(features)
    base = _vectors(df, key, features)
    cells = base.withColumn("cell", F.transform("v", lambda x: F.floor(x / eps)))
    shift = F.array(*[F.array(*[F.lit(int(d)) for d in np.unravel_index(i, (3,) * dims)]) for i in range(3**dims)])
    spread = cells.withColumn("_s", F.explode(shift)).withColumn("cell", F.zip_with("cell", "_s", lambda c, s: c + s - 1)).select("cell", F.col("id").alias("other"), F.col("v").alias("w"))
    links = durable(cells.join(spread, "cell").where(_distance_within(eps)).select("id", "other"))
    core = links.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples).select("id")
    inner = links.join(core, "id").join(core.withColumnRenamed("id", "other"), "other")
    name = lambda c: F.md5(F.col(c).cast("string"))
    found = components(inner.select(name("id").alias("a"), name("other").alias("b")))
    named = core.withColumn("node", name("id")).join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    label = durable(named.join(named.groupBy("component").agg(F.min("id").alias("label")), "component").select("id", "label"))
    border = links.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min(F.struct("other", "label")).alias("m")).select("id", F.col("m.label").alias("near"))
    out = base.select("id").join(label, "id", "left").join(border, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("label", "near", F.lit(-1)).alias("cluster"))


def isolation_forest(train: DataFrame, df: DataFrame, key: str, features: list[str], trees: int = 100, max_samples: int = 256, seed: int = 0) -> DataFrame:
    """(key, score): 2 ** (-mean depth / expected depth) over trees grown on samples drawn by digest.

    Trees grow in one grouped call, a tree a group of at most about ``max_samples``
    rows; the forest (bounded by its parameters) scores rows by a vectorised function.
    """
    rows = _vectors(train, key, features)
    n = rows.count()
    share = min(1.0, max_samples / max(1, n))
    # a row is copied only to the trees that draw it
    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 40)) < share * (1 << 40))
    drawn = rows.withColumn("tree", F.explode(hits))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x, state = np.stack(pdf["v"].to_numpy()), np.random.RandomState(int(pdf["tree"].iloc[0]) + 7919 * seed)
        x = x[np.lexsort(x.T[::-1])]
        top = int(np.ceil(np.log2(max(2, len(x)))))
        nodes: list[tuple] = []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, depth + _expected(len(part))))
            wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and depth < top else []
            if len(wide):
                f = int(wide[state.randint(len(wide))])
                cut = state.uniform(part[:, f].min(), part[:, f].max())
                low = node(part[part[:, f] < cut], depth + 1)
                high = node(part[part[:, f] >= cut], depth + 1)
                nodes[at] = (f, cut, low, high, 0.0)
            return at

        node(x, 0)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "size": [len(x)], "nodes": [np.array(nodes, dtype=np.float64).tobytes()]})

    forest = drawn.groupBy("tree").applyInPandas(grow, "tree int, size int, nodes binary").orderBy("tree").collect()  # trees x max_samples nodes at most
    shared = df.sparkSession.sparkContext.broadcast([(r["size"], np.frombuffer(r["nodes"]).reshape(-1, 5)) for r in forest])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(features)))
            total = np.zeros(len(x))
            for size, t in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = np.flatnonzero(t[at, 0] >= 0)
                    if not len(inner):
                        break
                    a = at[inner]
                    low = x[inner, t[a, 0].astype(int)] < t[a, 1]
                    at[inner] = np.where(low, t[a, 2], t[a, 3]).astype(int)
                total += t[at, 4] / max(_expected(size), 1e-12)
            yield pd.Series(2.0 ** (-total / max(1, len(shared.value))))

    made = F.pandas_udf(score, "double")
    return _vectors(df, key, features).select(F.col("id").alias(key), made("v").alias("score"))


def _expected(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

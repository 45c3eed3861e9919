"""The k most similar vectors of every vector, by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts by
recursive bisection; at each bisection a small logistic classifier learns which
side a vector belongs to. Every row is indexed in its most probable part, and
every query is sent to its several most probable parts and reranked there by
exact distance. An exact check then compares each query's reach with the boxes
of the parts it did not visit and sends it to those that could hold a closer
row, so the final result misses nothing; the recall of the first pass can be
measured against it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join
from .vectors import distinct_vectors, usable_records

#: Rows of the sample on which the partitions and classifiers are fitted, in the mean; twice as many at most.
SAMPLE_ROWS = 8_192
#: Distinct vectors a part should hold, and the most parts there can be.
PART_ROWS = 4_096
MAX_PARTS = 512
#: A part of more than so many times PART_ROWS vectors is searched in slices.
SLICED = 4
#: Parts a query visits at first.
PROBES = 3
#: Components by which the boxes of parts are looked up.
GRID_AXES = 4
#: Neighbours per vertex of the sample's graph.
GRAPH_DEGREE = 8


@dataclass(frozen=True)
class Router:
    """A binary tree of logistic classifiers; leaf i is part i."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (inner nodes, features)
    children: np.ndarray  # (inner nodes, 2): a node if >= 0, else part -1 - child
    parts: int

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -4, 4)
        d = z.shape[1]
        cross = [z[:, i] * z[:, j] for i in range(d) for j in range(i, d)] if d <= 8 else [z[:, i] ** 2 for i in range(d)]
        return np.column_stack([np.ones(len(z)), z, *cross])

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of every part for every row of ``x``."""
        out = np.zeros((len(x), self.parts))
        if self.parts == 1:
            return out
        side = self.features(x) @ self.weights.T
        reach = {0: np.zeros(len(x))}
        for k in range(len(self.children)):  # parents come before children
            here = reach.pop(k)
            for s, child in enumerate(self.children[k]):
                score = here - np.logaddexp(0, side[:, k] if s == 0 else -side[:, k])
                if child >= 0:
                    reach[int(child)] = score
                else:
                    out[:, -1 - int(child)] = score
        return out


def fit_router(sample: np.ndarray, parts: int) -> Router:
    """Balanced bisections of the sample's neighbour graph and their classifiers."""
    n, d = sample.shape
    parts = max(1, min(parts, n // 4))
    centre = np.median(sample, axis=0) if n else np.zeros(d)
    scale = np.percentile(np.abs(sample - centre), 75, axis=0) if n else np.ones(d)
    scale = np.where(scale > 0, scale, 1.0)
    if parts == 1:
        return Router(centre, scale, np.zeros((0, 1)), np.zeros((0, 2), int), 1)
    links = _neighbour_graph(sample, GRAPH_DEGREE)
    model = Router(centre, scale, np.zeros((0, 1)), np.zeros((0, 2), int), parts)
    feats = model.features(sample)
    weights, children, todo, leaves = [], [], [(np.arange(n), parts, None)], 0
    while todo:
        rows, k, up = todo.pop(0)
        if k == 1:
            children[up[0]][up[1]] = -1 - leaves
            leaves += 1
            continue
        me = len(weights)
        if up is not None:
            children[up[0]][up[1]] = me
        low = _bisect(sample, links, rows, (k // 2) / k)
        weights.append(_logistic(feats[rows], ~low))
        children.append([0, 0])
        todo += [(rows[low], k // 2, (me, 0)), (rows[~low], k - k // 2, (me, 1))]
    return Router(centre, scale, np.array(weights), np.array(children), parts)


def _neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of every row, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for i in range(0, n, 512):
        d = np.zeros((min(512, n - i), n))
        for c in range(x.shape[1]):
            d += (x[i : i + 512, c, None] - x[None, :, c]) ** 2
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(x: np.ndarray, links: np.ndarray, rows: np.ndarray, share: float) -> np.ndarray:
    """Mask of the first side: ``share`` of ``rows``, few graph links cut."""
    y = x[rows] - np.median(x[rows], axis=0)
    spread = np.percentile(np.abs(y), 90, axis=0)
    score = np.clip(y[:, int(np.argmax(spread))], -4 * max(spread.max(), 1e-30), 4 * max(spread.max(), 1e-30))
    place = np.full(len(x), -1)
    place[rows] = np.arange(len(rows))
    near = place[links[rows]]
    inside = near >= 0
    degree = np.maximum(1, inside.sum(1))
    for _ in range(10):  # smoothing over the graph pulls linked rows together
        score = 0.5 * score + 0.5 * np.where(inside.any(1), np.where(inside, score[near], 0).sum(1) / degree, score)
    size = min(len(rows) - 1, max(1, round(share * len(rows))))
    low = np.zeros(len(rows), bool)
    low[np.argsort(score, kind="stable")[:size]] = True
    for _ in range(8):  # balanced swaps: move the same number both ways while links are saved
        with_low = np.where(inside, low[near], False).sum(1)
        gain = np.where(low, inside.sum(1) - 2 * with_low, 2 * with_low - inside.sum(1))
        a, b = np.flatnonzero(low & (gain > 0)), np.flatnonzero(~low & (gain > 0))
        m = min(len(a), len(b))
        if not m:
            break
        a, b = a[np.argsort(-gain[a], kind="stable")[:m]], b[np.argsort(-gain[b], kind="stable")[:m]]
        low[a], low[b] = False, True
    return low


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(f.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (p - y) + ridge @ w
        h = (f * (p * (1 - p) + 1e-6)[:, None]).T @ f + ridge
        step = np.linalg.solve(h, grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def nearest_neighbours(
    df: DataFrame,
    id_col: str,
    components: list[str],
    k: int = 3,
    max_distance: float | None = None,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    exact: bool = True,
    every: int = 1,
) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest other records of every record.

    Distances are Euclidean in double precision, of equal distances the smaller
    id comes first, and neighbours farther than ``max_distance`` are left out.
    Records that hold no usable vector (see ``usable_records``) neither ask nor
    answer; repeated rows count once; copies of a vector under other ids are
    neighbours at distance 0. ``exact=False`` returns the first pass only.
    ``every`` > 1 asks only for ids divisible by it, against all records. With
    no usable record, or only one, there are no rows.
    """
    records = cut(usable_records(df, id_col, components))
    names = [c for c in records.columns if c != "id"]
    vecs = cut(distinct_vectors(records, k + 1))
    n = vecs.count()
    # a sample by hash: each task sends its share only, and about sample_rows come together
    share = min(1.0, sample_rows / max(1, n))
    drawn = vecs.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("vid", *names)
    sample = drawn.limit(2 * sample_rows).toArrow().to_pandas().sort_values("vid")[names].to_numpy(float)
    router = fit_router(sample.reshape(-1, len(names)), -(-n // part_rows) if n <= part_rows * MAX_PARTS else MAX_PARTS)
    shared = vecs.sparkSession.sparkContext.broadcast((router.centre, router.scale, router.weights, router.children, router.parts))
    placed = cut(vecs.mapInPandas(_router_pass(shared, names, probes), _schema(names) + ", n long, ids array<long>, home int, visits array<int>"))
    asking = placed if every == 1 else placed.where(F.exists("ids", lambda i: i % every == 0) | (F.col("n") > k))
    reach = float("inf") if max_distance is None else float(max_distance)
    cuts = _cuts(placed, names, part_rows)
    rows = _row_slices(placed.select("home", "vid", *names, "ids"), cuts, names)
    first = asking.select(F.explode("visits").alias("part"), "vid", *names, F.lit(reach).alias("bound"))
    got = cut(_best(_search(rows, _query_slices(first, cuts, names), names, k), k))
    if exact:
        more = _unvisited(placed, asking, got, names, k, reach)
        got = cut(_best(_flat(got).unionByName(_search(rows, _query_slices(more, cuts, names), names, k)), k))
    return _expand(records, placed, got, names, k, every)


def _schema(names: list[str]) -> str:
    return "vid long, " + ", ".join(f"{c} double" for c in names)


def _router_pass(shared, names, probes):
    def run(batches):
        router = Router(*shared.value)
        for b in batches:
            home, visits = [], []
            for i in range(0, len(b), 4096):
                p = router.log_probs(b[names].to_numpy(float)[i : i + 4096])
                m = min(probes, router.parts)
                top = np.argpartition(-p, m - 1, axis=1)[:, :m]
                home.append(np.argmax(p, axis=1))
                visits += list(top.astype(np.int32))
            yield b[["vid", *names, "n", "ids"]].assign(home=np.concatenate(home).astype(np.int32) if home else np.zeros(0, np.int32), visits=visits)

    return run


def _cuts(placed: DataFrame, names: list[str], part_rows: int) -> DataFrame | None:
    """(part, axis, cuts) of the parts too large for one task: quantiles of their widest component."""
    sizes = placed.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > SLICED * part_rows).collect()  # at most MAX_PARTS
    if not sizes:
        return None
    want = {r["home"]: -(-r["n"] // (2 * part_rows)) for r in sizes}
    large = placed.where(F.col("home").isin(list(want)))
    spread = [F.percentile_approx(c, [0.1, 0.9], 1000).alias(c) for c in names]
    axis = {r["home"]: max(range(len(names)), key=lambda i: r[names[i]][1] - r[names[i]][0]) for r in large.groupBy("home").agg(*spread).collect()}
    axes = F.element_at(F.create_map(*[F.lit(x) for kv in axis.items() for x in kv]), F.col("home"))
    most = max(want.values())
    value = F.element_at(F.array(*names), axes + 1)
    steps = large.groupBy("home").agg(F.percentile_approx(value, [i / most for i in range(1, most)], 10_000).alias("q")).collect()
    out = [(r["home"], axis[r["home"]], sorted({r["q"][most * i // want[r["home"]] - 1] for i in range(1, want[r["home"]])})) for r in steps]
    return cut(placed.sparkSession.createDataFrame(out, "__part int, axis int, cuts array<double>"))


def _with_cuts(df: DataFrame, part: str, cuts: DataFrame | None, names: list[str]) -> DataFrame:
    if cuts is None:
        return df.withColumns({"axis": F.lit(0), "cuts": F.array().cast("array<double>")})
    joined = df.join(F.broadcast(cuts), F.col(part) == F.col("__part"), "left").drop("__part")  # at most MAX_PARTS rows
    return joined.withColumns({"axis": F.coalesce("axis", F.lit(0)), "cuts": F.coalesce("cuts", F.array().cast("array<double>"))})


def _row_slices(rows: DataFrame, cuts: DataFrame | None, names: list[str]) -> DataFrame:
    value = F.element_at(F.array(*names), F.col("axis") + 1)
    return _with_cuts(rows, "home", cuts, names).withColumn("slice", F.size(F.filter("cuts", lambda c: c <= value))).drop("axis", "cuts")


def _query_slices(queries: DataFrame, cuts: DataFrame | None, names: list[str]) -> DataFrame:
    """A query goes to every slice its reach touches."""
    value, wide = F.element_at(F.array(*names), F.col("axis") + 1), F.col("bound") * (1 + 1e-9)
    low, high = F.size(F.filter("cuts", lambda c: c <= value - wide)), F.size(F.filter("cuts", lambda c: c <= value + wide))
    return _with_cuts(queries, "part", cuts, names).withColumn("slice", F.explode(F.sequence(low, high))).drop("axis", "cuts")


def _search(rows: DataFrame, queries: DataFrame, names: list[str], k: int) -> DataFrame:
    """(vid, d, id): per query and slice of a part the k nearest ids of other vectors there."""

    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"vid": [], "d": [], "id": []}
        if len(index) and len(asked):
            asked = asked.rename(columns=lambda c: c.removeprefix("q_"))
            x, q = index[names].to_numpy(float), asked[names].to_numpy(float)
            axis = int(np.argmax(np.percentile(x, 90, axis=0) - np.percentile(x, 10, axis=0)))
            index, x = index.iloc[o := np.argsort(x[:, axis], kind="stable")], x[o]
            asked, q = asked.iloc[p := np.argsort(q[:, axis], kind="stable")], q[p]
            vids, ids = index["vid"].to_numpy(), [i[:k] for i in index["ids"]]
            held = np.array([len(i) for i in ids])
            flat, first = np.concatenate(ids), np.cumsum(held) - held
            asks, bound = asked["vid"].to_numpy(), asked["bound"].to_numpy(float)
            line, step = x[:, axis], 128
            for i in range(0, len(q), step):
                qs, bs = q[i : i + step], bound[i : i + step]
                most = bs.max() * (1 + 1e-9)  # rounding makes equal what differs by less
                lo = np.searchsorted(line, qs[0, axis] - most, "left") if np.isfinite(most) else 0
                hi = np.searchsorted(line, qs[-1, axis] + most, "right") if np.isfinite(most) else len(x)
                if hi <= lo:
                    continue
                s = np.zeros((len(qs), hi - lo))
                for c in range(x.shape[1]):
                    s += (qs[:, c, None] - x[None, lo:hi, c]) ** 2
                s[asks[i : i + step, None] == vids[None, lo:hi]] = np.inf
                dist = np.sqrt(s)
                dist[dist > bs[:, None]] = np.inf
                m = min(k, hi - lo)
                cutoff = np.partition(dist, m - 1, axis=1)[:, m - 1]
                a, b = np.nonzero((dist <= cutoff[:, None]) & np.isfinite(dist))  # ties at the border stay
                many = held[lo + b]
                out["vid"].append(np.repeat(asks[i + a], many))
                out["d"].append(np.repeat(dist[a, b], many))
                out["id"].append(flat[np.repeat(first[lo + b], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
        none = [np.zeros(0, np.int64)]
        frame = pd.DataFrame({c: np.concatenate([*v, *none]).astype(float if c == "d" else np.int64) for c, v in out.items()})
        if len(frame):
            frame = frame.iloc[np.lexsort((frame["id"], frame["d"], frame["vid"]))].groupby("vid", sort=False).head(k)
        return frame

    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return rows.groupBy("home", "slice").cogroup(queries.groupBy("q_part", "q_slice")).applyInPandas(run, "vid long, d double, id long")


def _flat(got: DataFrame) -> DataFrame:
    return got.select("vid", F.explode("best").alias("b")).select("vid", F.col("b.d").alias("d"), F.col("b.id").alias("id"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of at most k candidates per visited part and slice, as one array."""
    return found.groupBy("vid").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "id"))), 1, k).alias("best"))


def _unvisited(placed: DataFrame, asking: DataFrame, got: DataFrame, names: list[str], k: int, reach: float) -> DataFrame:
    """The (query, part) pairs that could hold a closer row but were not visited.

    Every part is covered by boxes, one per coarse grid cell of the first
    GRID_AXES components; a query looks up the cells its reach touches, which
    are two to the power of these at most. Without a finite reach for some query all its
    unvisited parts' boxes count, found through one box per part.
    """
    side = max(16 * reach if np.isfinite(reach) else 0.0, 1e-6)
    # a query with k neighbours asks to the farthest of them, else to the limit;
    # exact copies of itself count as neighbours at distance 0
    ask = asking.select("vid", *names, "n", "visits").join(got.withColumnRenamed("vid", "__v"), F.col("vid") == F.col("__v"), "left")
    have = F.coalesce(F.size("best"), F.lit(0))
    short = F.lit(k) - (F.col("n") - 1)  # places not taken by copies
    kth = F.when(have >= short, F.element_at("best", F.greatest(short, F.lit(1)).cast("int"))["d"])
    ask = ask.withColumn("bound", F.when(short <= 0, F.lit(0.0)).otherwise(F.coalesce(kth, F.lit(reach)))).where("n <= %d" % k)
    ask = ask.select("vid", *names, "visits", "bound")
    if np.isfinite(reach):
        grid = names[:GRID_AXES]
        where = F.struct(*[F.rint(F.col(c) / side).alias(c) for c in grid])
        boxes = placed.withColumn("__cell", where)
        axes = [
            F.when(F.rint((F.col(c) - F.col("bound")) / side) == F.rint((F.col(c) + F.col("bound")) / side), F.array(F.rint(F.col(c) / side))).otherwise(
                F.array(F.rint((F.col(c) - F.col("bound")) / side), F.rint((F.col(c) + F.col("bound")) / side))
            )
            for c in grid
        ]
        for i, axis in enumerate(axes):
            ask = ask.withColumn(f"__a{i}", F.explode(axis))
        ask = ask.withColumn("__at", F.struct(*[F.col(f"__a{i}").alias(c) for i, c in enumerate(grid)])).drop(*[f"__a{i}" for i in range(len(grid))])
    else:
        boxes, ask = placed.withColumn("__cell", F.struct(F.lit(0.0).alias("all"))), ask.withColumn("__at", F.struct(F.lit(0.0).alias("all")))
    per_part = boxes.groupBy("__cell", "home").agg(*[F.min(c).alias(f"lo_{c}") for c in names], *[F.max(c).alias(f"hi_{c}") for c in names])
    box = F.struct("home", *[f"lo_{c}" for c in names], *[f"hi_{c}" for c in names])
    cells = cut(per_part.groupBy("__cell").agg(F.collect_list(box).alias("boxes")))  # at most one per part
    near = lookup_join(ask, cells, "__at", "__cell", "inner")

    def far2(b):
        total = F.lit(0.0)
        for c in names:
            total = total + F.pow(F.greatest(b[f"lo_{c}"] - F.col(c), F.col(c) - b[f"hi_{c}"], F.lit(0.0)), 2)
        return total

    slack = F.col("bound") * F.col("bound") * (1 + 1e-9)
    wanted = F.filter("boxes", lambda b: ~F.array_contains("visits", b["home"]) & (far2(b) <= slack))
    hits = near.withColumn("__b", F.explode(wanted)).select(F.col("__b.home").alias("part"), "vid", *names, "bound")
    return hits.distinct()


def _expand(records: DataFrame, placed: DataFrame, got: DataFrame, names: list[str], k: int, every: int) -> DataFrame:
    """From vectors to records: own copies first, then the others found."""
    found = placed.select("vid", *names, "n", "ids").join(got.withColumnRenamed("vid", "__v"), F.col("vid") == F.col("__v"), "left")
    others = F.coalesce("best", F.array().cast("array<struct<d:double,id:bigint>>"))
    found = found.select("vid", *names, "n", "ids", others.alias("others"))
    few = found.where(F.col("n") <= k + 1).select(F.explode("ids").alias("id"), "ids", "others")
    many = cut(found.where(F.col("n") > k + 1).select(F.struct(*names).alias("__v"), "ids", "others"))
    held = records.withColumn("__w", F.struct(*names))
    crowd = lookup_join(held, many, "__w", "__v", "inner").select("id", "ids", "others")
    every_id = few.unionByName(crowd)
    if every > 1:
        every_id = every_id.where(F.col("id") % every == 0)
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    ranked = every_id.withColumn("__all", F.slice(F.concat(own, "others"), 1, k))
    return ranked.select("id", F.posexplode("__all").alias("rank", "__b")).select(
        "id", F.col("__b.id").alias("neighbour"), F.col("__b.d").alias("distance"), (F.col("rank") + 1).cast("int").alias("rank")
    )

"""Clusters of mutually similar records from mergeable cluster features.

Each partition inserts its vectors into a cluster-feature tree, whose entries
take what lies within a threshold of their first vector. An entry is named by
the cell of that vector on a fine grid, which makes the trees of any partitions
mergeable: the features (count, linear sum, square sum, box) are Spark's partial
aggregates by that name, and their reduction merges the trees' leaves, and then
the leaves of a coarser cell to a node. Leaves within reach of each other are joined to
components, inside a component the leaves are agglomerated by Ward's criterion
in rounds that merge all pairs which are each other's cheapest, and one pass over
all records assigns each to its component's nearest centroid. The clusters with
their records, sizes and boxes are the candidates for sets of records that are
all similar to each other: an exact check confirms those whose box proves it,
joins those that lie within the radius of each other and searches what neither
settles.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, united
from ..runtime import cut, lookup_join
from .cftree import CFTree
from .cliques import NONE, best_first
from .vectors import distinct_vectors, usable_records

#: Cells of leaves per radius along each axis, and those of a node; the share of
#: the radius within which an entry takes vectors. A node is as wide as the radius
#: and two thresholds, so that vectors in reach are in the same or the next node.
SPLIT, NODE, ABSORB = 4, 5, 0.125
#: Clusters up to which a round of the Ward agglomeration compares all pairs; beyond that by a grid.
WARD_LEAVES = 600
#: Clusters of a component up to which one task agglomerates it; rounds of larger ones are made by tiles.
WARD_ROWS = 20_000
#: A Ward merge is made while the root mean square pair distance stays below this share of the radius,
#: of clusters whose centroids are not farther apart than so many times that bound (two radii).
WARD_SHARE, WARD_FAR = 0.75, 8 / 3
#: Pairs compared at once.
WARD_PAIRS = 1_000_000
#: Components used for the grid of nodes; more components only refine the leaves.
GRID_DIMS = 4
#: Distinct vectors of linked clusters up to which one task searches them, with a
#: bit for every pair; beyond that they are searched tile by tile, in rounds.
PAIR_ROWS = 4_096
#: Radii along each axis of a tile.
TILE = 16
#: Steps of listing all maximal cliques, before they are searched best first by bounds.
CLIQUE_STEPS = 300_000


@dataclass(frozen=True)
class Clustering:
    """``assigned``: (vid, x0.., n, component, label) per distinct vector;
    ``clusters``: (component, label, cluster_id, size, n_vectors, m_x0.., lo_x0.., hi_x0..)
    per cluster; ``records``: (id, x0..)."""

    assigned: DataFrame
    clusters: DataFrame
    records: DataFrame
    names: list[str]
    radius: float

    @cached_property
    def vectors(self) -> DataFrame:
        """``assigned`` with ``cluster_id`` and the distance ``d`` to the cluster's centroid."""
        means = self.clusters.select(F.struct("component", "label").alias("__key"), "cluster_id", *[f"m_{c}" for c in self.names])
        joined = lookup_join(self.assigned.withColumn("__ck", F.struct("component", "label")), means, "__ck", "__key", "inner")
        d2 = _sum(F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in self.names)
        return joined.select(*self.assigned.columns, "cluster_id", F.sqrt(d2).alias("d"))


def _sum(terms) -> Column:
    first, *rest = terms
    return sum(rest, first)


def similarity_clusters(df: DataFrame, id_col: str, components: list[str], radius: float) -> Clustering:
    """Cluster the usable records of ``df`` (see ``usable_records``).

    Every usable record gets exactly one cluster, lonely ones a cluster of
    their own. Repeated rows count once, copies of a vector under other ids
    share its cluster. ``cluster_id`` is the smallest id in the cluster. An
    empty table, or one without usable records, gives no clusters. Other
    columns are ignored.
    """
    records = cut(usable_records(df, id_col, components))
    names = [c for c in records.columns if c != "id"]
    grid = names[:GRID_DIMS]
    side = radius / SPLIT * (1 + 1e-6)
    leaf = F.struct(*[F.rint(F.col(f"f_{c}") / side).alias(c) for c in names])
    point = ", ".join(f"{c} double" for c in names)
    vecs = distinct_vectors(records, 1).select("vid", *names, "n")
    vecs = vecs.mapInPandas(_tree(names, ABSORB * radius), f"vid long, {point}, n long, " + point.replace("x", "f_x"))
    vecs = cut(vecs.select("vid", *names, "n", leaf.alias("leaf")))
    leaves = vecs.groupBy("leaf").agg(
        F.min("vid").alias("lid"),
        F.sum("n").alias("n"),
        *[F.sum(F.col(c) * F.col("n")).alias(f"s_{c}") for c in names],
        F.sum(F.col("n") * _sum(F.col(c) * F.col(c) for c in names)).alias("ss"),
        *[F.min(c).alias(f"lo_{c}") for c in names],
        *[F.max(c).alias(f"hi_{c}") for c in names],
    )
    wide = [F.col(f"leaf.{c}") / NODE for c in grid]
    node = F.struct(*[(w - F.pmod(w, F.lit(1.0))).alias(c) for w, c in zip(wide, grid)])
    leaves = cut(leaves.withColumn("node", node))
    nodes = cut(
        leaves.groupBy("node").agg(
            F.min("lid").alias("nid"), *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in names], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in names]
        )
    )
    linked = connected_components(_node_links(nodes, names, grid, radius), "nid", "other")
    linked = linked.withColumnRenamed("node", "__n").withColumnRenamed("component", "__c")
    nodes = nodes.join(linked, F.col("nid") == F.col("__n"), "left").select(F.col("node").alias("__node"), F.coalesce("__c", "nid").alias("component"))
    leaves = cut(leaves.join(nodes, F.col("node") == F.col("__node")).drop("__node", "node"))
    ward = _ward_all(leaves, names, radius)
    table = cut(leaves.select(F.col("leaf").alias("__leaf"), "lid", "component").join(ward.withColumnRenamed("lid", "__l"), F.col("lid") == F.col("__l")).select("__leaf", "component", "cands", "cents"))
    placed = lookup_join(vecs, table, "leaf", "__leaf", "inner")
    width = len(names)

    def off(i):
        total = F.lit(0.0)
        for j, c in enumerate(names):
            total = total + F.pow(F.col(c) - F.get("cents", i * width + j), 2)
        return F.struct(total.alias("d2"), F.get("cands", i).alias("label"))

    nearest = F.when(F.size("cands") == 1, F.get("cands", F.lit(0))).otherwise(
        F.array_min(F.transform(F.sequence(F.lit(0), F.size("cands") - 1), off))["label"]
    )
    placed = cut(placed.select("vid", *names, "n", "component", nearest.alias("label")))
    clusters = placed.groupBy("component", "label").agg(
        F.min("vid").alias("cluster_id"),
        F.sum("n").alias("size"),
        F.count("*").alias("n_vectors"),
        *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m_{c}") for c in names],
        *[F.min(c).alias(f"lo_{c}") for c in names],
        *[F.max(c).alias(f"hi_{c}") for c in names],
    )
    return Clustering(placed, cut(clusters), records, names, radius)


def typical_members(c: Clustering, top: int = 3) -> DataFrame:
    """(cluster_id, size, rms, members): per cluster its size, the root mean square
    distance to its centroid and the ids of the ``top`` vectors closest to it, the
    smaller id first where distances are equal. A copy's id stands for all copies."""
    w = Window.partitionBy("cluster_id").orderBy("d", "vid")
    near = c.vectors.select("cluster_id", "d", "vid").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top)
    members = near.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("__r", "vid"))).alias("m"))
    sizes = c.vectors.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.sqrt(F.sum(F.col("n") * F.col("d") * F.col("d")) / F.sum("n")).alias("rms"))
    return sizes.join(members, "cluster_id").select("cluster_id", "size", "rms", F.transform("m", lambda m: m["vid"]).alias("members"))


def cliques(c: Clustering, min_size: int) -> DataFrame:
    """(id, cluster_id): the exact check of the clusters.

    A set of records of which every two lie within the radius never reaches
    from one cluster into another whose box is farther away. So clusters whose
    boxes lie within the radius are linked, and each group of linked clusters
    is settled by itself: groups of fewer than ``min_size`` records hold no
    set, a group whose box is small enough is one, and in the others the
    maximal sets are found; of overlapping sets the larger stays (of equal
    ones that with the smallest id the other lacks). One task searches a group
    of at most PAIR_ROWS distinct vectors; larger ones are searched by tiles.
    """
    names, radius = c.names, c.radius
    groups = cut(_linked(c, min_size))
    held = lookup_join(c.assigned.withColumn("__ck", F.struct("component", "label")), groups, "__ck", "__key", "inner")
    held = cut(held.select("grp", "settled", "many", "vid", "n", *names, "label"))
    point = ["vid", "n", *names]
    whole = held.where("settled").select(*point, F.col("grp").alias("cluster_id"))

    def search(batches):
        for got in _whole(batches, ["grp"], [*point, "label"]):
            vid, n, x, label = got[0], got[1], np.column_stack(got[2:-1]), got[-1]
            chosen = _component_cliques(x, n, vid, label, radius, min_size)
            ok = chosen != _NONE
            yield pd.DataFrame({"vid": vid[ok], "n": n[ok], **{k: x[ok, i] for i, k in enumerate(names)}, "cluster_id": chosen[ok]})

    schema = "vid long, n long, " + ", ".join(f"{x} double" for x in names) + ", cluster_id long"
    rest = held.where("not settled").select("grp", "many", *point, "label")
    found = whole.unionByName(_by_key(rest.where("not many"), "grp").mapInPandas(search, schema))
    if not groups.where("many and not settled").isEmpty():
        found = found.unionByName(_by_tiles(rest.where("many").select("grp", *point), names, radius, min_size))
    found = cut(found)
    single = found.where("n = 1").select(F.col("vid").alias("id"), "cluster_id")
    copies = cut(found.where("n > 1").select(F.struct(*names).alias("__v"), "cluster_id"))
    held = c.records.withColumn("__w", F.struct(*names))
    return single.unionByName(lookup_join(held, copies, "__w", "__v", "inner").select("id", "cluster_id"))


def _linked(c: Clustering, min_size: int) -> DataFrame:
    """(__key, grp, settled, many) of each cluster of a group of at least ``min_size`` records.

    ``grp`` is the smallest id of the group; ``settled`` tells that its box
    proves all distances, ``many`` that it has more than PAIR_ROWS vectors.
    """
    names, radius, rows = c.names, c.radius, PAIR_ROWS
    columns = ["label", "cluster_id", "size", "n_vectors", *[f"{p}_{x}" for p in ("lo", "hi") for x in names]]

    d = len(names)

    def settle(comps: list, held: list) -> pd.DataFrame:
        """Groups of many components at once."""
        sizes = [len(h[0]) for h in held]
        label, low, size, vectors, *box = (np.concatenate(x) for x in zip(*held))
        lo, hi = np.column_stack(box[:d]), np.column_stack(box[d:])
        left, right, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for k in sizes:
            if k > 1:
                a, b = _near_boxes(lo[at : at + k], hi[at : at + k], radius)
                left.append(a + at)
                right.append(b + at)
            at += k
        group = np.unique(united(at, np.concatenate(left), np.concatenate(right)), return_inverse=True)[1].ravel()
        k = group.max() + 1
        total, many = (np.bincount(group, v, k).astype(np.int64) for v in (size, vectors))
        least, a, b = np.full(k, np.iinfo(np.int64).max), np.full((k, d), np.inf), np.full((k, d), -np.inf)
        np.minimum.at(least, group, low)
        np.minimum.at(a, group, lo)
        np.maximum.at(b, group, hi)
        settled = ((b - a) ** 2).sum(1) <= radius * radius * (1 - 1e-12)
        out = {"component": np.repeat(comps, sizes), "label": label, "grp": least[group], "settled": settled[group], "many": (many > rows)[group]}
        return pd.DataFrame(out)[total[group] >= min_size]

    def run(batches):
        comps, held, count = [], [], 0
        for comp, got in _whole(batches, ["component"], columns, with_key=True):
            comps.append(comp)
            held.append(got)
            count += len(got[0])
            if count >= 20_000:
                yield settle(comps, held)
                comps, held, count = [], [], 0
        if held:
            yield settle(comps, held)

    boxes = _by_key(c.clusters.select("component", *columns), "component")
    out = boxes.mapInPandas(run, "component long, label long, grp long, settled boolean, many boolean")
    return out.select(F.struct("component", "label").alias("__key"), "grp", "settled", "many")


def _near_boxes(lo: np.ndarray, hi: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of boxes within the radius of each other, each box with itself among them."""
    k = len(lo)
    axis, order = 0, np.arange(k)
    if k > 256:  # along the widest axis only boxes in reach are compared
        axis = int(np.argmax(np.ptp(np.clip(lo, *np.percentile(lo, [1, 99], axis=0)), axis=0)))
        order = np.argsort(lo[:, axis], kind="stable")
        lo, hi = lo[order], hi[order]
    left, right = [], []
    for i in range(0, k, 256):
        j = slice(i, i + 256)
        last = k if k <= 256 else np.searchsorted(lo[:, axis], hi[j, axis].max() + radius * (1 + 1e-9), "right")
        for at in range(i, last, 4096):
            other = slice(at, min(at + 4096, last))
            apart = np.maximum(0, np.maximum(lo[j, None] - hi[None, other], lo[None, other] - hi[j, None]))
            a, b = np.nonzero((apart**2).sum(2) <= radius * radius * (1 + 1e-9))
            left.append(order[a + i])
            right.append(order[b + at])
    return np.concatenate(left), np.concatenate(right)


def _by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key one after the other in one task; as many tasks as shuffles have, as the work is in Python."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def _by_tiles(rows: DataFrame, names: list[str], radius: float, min_size: int) -> DataFrame:
    """(vid, n, x0.., cluster_id) of the vectors of large groups that are in a chosen set.

    A task holds the vectors of a tile and those within three radii of it. It
    chooses the sets owned by the tile's vectors that come before all they may
    overlap; what depends on a neighbour tile waits for the next round. The
    first of all that are left can always be chosen, so the rounds end.
    """
    halo = 3 * radius * (1 + 1e-6)
    axes = names[:GRID_DIMS]
    columns = ["vid", "n", "free", "home", *names]

    def run(batches):
        for got in _whole(batches, ["grp", *[f"t_{c}" for c in axes]], columns):
            vid, n, free, home = got[0], got[1], got[2].astype(bool), got[3].astype(bool)
            if (free & home).any():
                chosen = best_first(np.column_stack(got[4:]), n, vid, radius, min_size, home, free)
                ok = chosen != NONE
                yield pd.DataFrame({"__vid": vid[ok], "__set": chosen[ok]})

    state = cut(rows.withColumn("cluster_id", F.lit(None).cast("long")))
    while True:
        tiled = _tiled(state.withColumn("free", F.col("cluster_id").isNull()), axes, radius, halo)
        keys = ["grp", *[f"t_{c}" for c in axes]]
        tiled = _by_key(tiled.select(*keys, *columns), *keys)
        found = cut(tiled.mapInPandas(run, "__vid long, __set long"))
        if found.isEmpty():
            return state.where("cluster_id is not null").drop("grp")
        state = cut(state.join(found, F.col("vid") == F.col("__vid"), "left").select(*rows.columns, F.coalesce("cluster_id", "__set").alias("cluster_id")))


def _tiled(df: DataFrame, axes: list[str], radius: float, halo: float) -> DataFrame:
    """Each row once per tile (t_x0..) that it lies in or within ``halo`` of; ``home`` tells which it lies in."""
    side = F.lit(TILE * radius)
    df = df.withColumn("home", F.lit(True))
    for c in axes:
        low, at, high = (F.floor((F.col(c) + F.lit(o)) / side) for o in (-halo, 0.0, halo))
        df = df.withColumn(f"b_{c}", at).withColumn(f"t_{c}", F.explode(F.sequence(low, high)))
        df = df.withColumn("home", F.col("home") & (F.col(f"b_{c}") == F.col(f"t_{c}"))).withColumn(f"t_{c}", F.col(f"t_{c}").cast("double"))
    return df


_NONE = NONE


def _tree(names: list[str], threshold: float):
    """Each vector with the first one of its entry in the partition's tree."""

    def run(batches):
        tree = CFTree(threshold)
        for b in batches:
            first = tree.insert(b[names].to_numpy(float))
            yield b.assign(**{f"f_{c}": first[:, i] for i, c in enumerate(names)})

    return run


def _node_links(nodes: DataFrame, names: list[str], grid: list[str], radius: float) -> DataFrame:
    """(nid, other): nodes of neighbouring cells whose boxes lie within the radius."""
    steps = [o for o in itertools.product((-1.0, 0.0, 1.0), repeat=len(grid)) if o > (0.0,) * len(grid)]
    side, over = radius / SPLIT * (1 + 1e-6), ABSORB * radius * (1 + 1e-6)
    width = NODE * side

    def probe(batches):
        for b in batches:
            lo, hi = b[[f"lo_{c}" for c in grid]].to_numpy(), b[[f"hi_{c}" for c in grid]].to_numpy()
            key = np.array([[k[c] for c in grid] for k in b["node"]]) if len(b) else np.zeros((0, len(grid)))
            # a node covers its cell's leaves, each half a leaf off the multiples of the
            # side, and what lies within the threshold around them
            base = (key * NODE - 0.5) * side
            for o in steps:
                step = np.array(o)
                at = base + step * width
                gap = np.maximum(0, np.maximum(at - over - hi, lo - (at + width + over)))
                ok = (gap**2).sum(1) <= (radius * (1 + 1e-4)) ** 2 + 1e-9 * np.abs(base).max(initial=0.0)
                if not ok.any():
                    continue
                out = b.loc[ok, ["nid", *[f"lo_{c}" for c in names], *[f"hi_{c}" for c in names]]]
                for j, c in enumerate(grid):
                    out[f"k_{c}"] = key[ok, j] + o[j]
                yield out

    boxes = ", ".join(f"{p}_{c} double" for p in ("lo", "hi") for c in names)
    keys = ", ".join(f"k_{c} double" for c in grid)
    probes = nodes.mapInPandas(probe, f"nid long, {boxes}, {keys}")
    probes = probes.select("nid", *[F.col(f"{p}_{c}").alias(f"p{p}_{c}") for p in ("lo", "hi") for c in names], F.struct(*[F.col(f"k_{c}").alias(c) for c in grid]).alias("__at"))
    other = nodes.withColumnRenamed("nid", "other")
    gap2 = F.lit(0.0)
    for c in names:
        gap2 = gap2 + F.pow(F.greatest(F.col(f"plo_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"phi_{c}"), F.lit(0.0)), 2)
    return probes.join(other, F.col("__at") == F.col("node")).where(gap2 <= radius * radius * (1 + 1e-9)).select("nid", "other")


def _ward_all(leaves: DataFrame, names: list[str], radius: float) -> DataFrame:
    """(lid, cands, cents): per leaf the clusters of its component that may be nearest to its records."""
    count = leaves.groupBy("component").agg(F.count("*").alias("__k")).withColumnRenamed("component", "__comp")
    counted = leaves.join(count, F.col("component") == F.col("__comp")).drop("__comp")
    mean = [(F.col(f"s_{c}") / F.col("n")) for c in names]
    alone = counted.where("__k = 1").select("lid", F.array(F.lit(0).cast("long")).alias("cands"), F.array(*mean).alias("cents"))
    flat = counted.where("__k > 1").select(
        "__k", "component", "lid", "n", "ss", *[F.col(f"s_{c}").alias(f"s_{c}") for c in names], *[F.col(f"leaf.{c}").alias(f"k_{c}") for c in names]
    )

    width = len(names)

    def run(batches):
        for lid, *block in _whole(batches, ["component"], ["lid", "n", "ss", *[f"s_{c}" for c in names], *[f"k_{c}" for c in names]]):
            cands, cents = _component_ward(np.column_stack(block).astype(float), width, radius, lid)
            yield pd.DataFrame({"lid": lid, "cands": cands, "cents": cents})

    # a component's rows follow each other; whole ones are handled many to a batch
    many = _by_key(flat.where(F.col("__k") <= WARD_ROWS).drop("__k"), "component").mapInPandas(run, "lid long, cands array<long>, cents array<double>")
    out = alone.unionByName(many)
    if not count.where(F.col("__k") > WARD_ROWS).isEmpty():
        out = out.unionByName(_ward_tiles(cut(flat.where(F.col("__k") > WARD_ROWS).drop("__k")), names, radius))
    return out


def _ward_tiles(flat: DataFrame, names: list[str], radius: float) -> DataFrame:
    """``_component_ward`` of components too large for one task: tasks hold tiles and what is in reach of them."""
    most, axes, sums = (WARD_SHARE * radius) ** 2, names[:GRID_DIMS], [F.sum(f"s_{c}").alias(f"s_{c}") for c in names]
    whole = flat.groupBy(F.col("component").alias("__comp")).agg(F.sum("n").alias("__n"), F.sum("ss").alias("__ss"), *[x.alias(f"__s_{c}") for x, c in zip(sums, names)])
    spread = 2 * (F.col("__ss") - _sum(F.pow(F.col(f"__s_{c}"), 2) for c in names) / F.col("__n"))
    one = whole.where(spread <= F.lit(most) * F.greatest(F.lit(1), F.col("__n") - 1))  # the agglomeration may go all the way
    one = cut(one.select("__comp", F.array(*[F.col(f"__s_{c}") / F.col("__n") for c in names]).alias("cents")))
    done = flat.join(one, F.col("component") == F.col("__comp")).select("lid", F.array(F.lit(0).cast("long")).alias("cands"), "cents")
    flat = cut(flat.join(one, F.col("component") == F.col("__comp"), "left_anti"))
    roots = _ward_roots(flat, names, radius)
    held = flat.join(roots, F.col("lid") == F.col("__leaf"), "left").withColumn("root", F.coalesce("root", "lid"))
    cent = held.groupBy("component", "root").agg(F.sum("n").alias("n"), *sums)
    cent = cent.select("component", "root", *[(F.col(f"s_{c}") / F.col("n")).alias(c) for c in names])
    place = 1 + F.pmod(F.xxhash64(*[F.floor(F.col(c) / (TILE * radius)) for c in axes]), F.lit(1 << 30))
    cent = cent.withColumn("__p", place)
    number = F.row_number().over(Window.partitionBy("component", "__p").orderBy("root")) - 1
    cent = cut(cent.select("component", (F.shiftleft("__p", 32) + number).alias("label"), *names, *[F.lit(0.0).alias(f"k_{c}") for c in names]))
    left = flat.select("component", F.col("lid").alias("label"), *[(F.col(f"s_{c}") / F.col("n")).alias(c) for c in names], *[f"k_{c}" for c in names])
    keys, d, halo = ["component", *[f"t_{c}" for c in axes]], len(names), 4 * radius
    columns = ["leaf", "label", *names, *[f"k_{c}" for c in names]]
    while True:

        def run(batches, halo=halo):
            for got in _whole(batches, keys, columns):
                leaf, label, x, k = got[0].astype(bool), got[1], np.column_stack(got[2 : 2 + d]), np.column_stack(got[2 + d :])
                if leaf.any():
                    cands, cents = _nearest_cents(x[leaf], k[leaf], x[~leaf], radius, halo)
                    yield pd.DataFrame({"lid": label[leaf], "cands": [None if c is None else label[~leaf][c] for c in cands], "cents": cents})

        both = _tiled(left.withColumn("leaf", F.lit(True)), axes, radius, 0.0).unionByName(_tiled(cent.withColumn("leaf", F.lit(False)), axes, radius, halo))
        found = cut(_by_key(both.select(*keys, *columns), *keys).mapInPandas(run, "lid long, cands array<long>, cents array<double>"))
        done = done.unionByName(found.where("cands is not null"))
        far = found.where("cands is null").select(F.col("lid").alias("__lid"))
        if far.isEmpty():
            return done
        left, halo = left.join(far, F.col("label") == F.col("__lid"), "left_semi"), 2 * halo


def _ward_roots(flat: DataFrame, names: list[str], radius: float) -> DataFrame:
    """(__leaf, root) of leaves that are merged: the rounds of ``_ward`` over tiles, until a task can hold what is left of a component."""
    most, axes, d = (WARD_SHARE * radius) ** 2, names[:GRID_DIMS], len(names)
    halo, values = WARD_FAR * WARD_SHARE * radius * (1 + 1e-6), ["n", "sse", *names]
    mean = [(F.col(f"s_{c}") / F.col("n")).alias(c) for c in names]
    sse = F.greatest(F.lit(0.0), F.col("ss") - _sum(F.pow(F.col(f"s_{c}"), 2) for c in names) / F.col("n"))
    state = cut(flat.select("component", "lid", F.col("n").cast("double").alias("n"), sse.alias("sse"), *mean))
    keys = ["component", *[f"t_{c}" for c in axes]]

    def search(batches):
        for lid, home, n, sse, *x in _whole(batches, keys, ["lid", "home", *values]):
            rows = np.flatnonzero(home.astype(bool))
            at = _partners(n, np.column_stack(x), sse, lid, most, rows)
            yield pd.DataFrame({"lid": lid[rows[at >= 0]], "partner": lid[at[at >= 0]]})

    def finish(batches):
        for lid, n, sse, *x in _whole(batches, ["component"], ["lid", *values]):
            label = _ward(n, np.column_stack(x), sse, most, lid)
            root = np.full(label.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(root, label, lid)
            yield pd.DataFrame({"lid": root[label], "other": lid})[root[label] != lid]

    merges = state.select("lid", F.col("lid").alias("other")).limit(0)
    while True:
        counts = cut(state.groupBy(F.col("component").alias("__comp")).agg(F.count("*").alias("__k")).where(F.col("__k") <= WARD_ROWS))
        if not counts.isEmpty():
            few = state.join(counts, F.col("component") == F.col("__comp"), "left_semi")
            merges = merges.unionByName(cut(_by_key(few, "component").mapInPandas(finish, "lid long, other long")))
            state = cut(state.join(counts, F.col("component") == F.col("__comp"), "left_anti"))
        tiled = _tiled(state, axes, radius, halo).select(*keys, "lid", "home", *values)
        best = cut(_by_key(tiled, *keys).mapInPandas(search, "lid long, partner long"))
        back = best.select(F.col("partner").alias("lid"), F.col("lid").alias("partner"))
        pairs = cut(best.join(back, ["lid", "partner"], "left_semi").where("lid < partner").select("lid", F.col("partner").alias("other")))
        if pairs.isEmpty():
            break
        merges = merges.unionByName(pairs)
        roles = pairs.select(F.col("other").alias("__l"), F.col("lid").alias("root"))
        now = state.join(roles, F.col("lid") == F.col("__l"), "left").withColumn("root", F.coalesce("root", "lid"))
        row = F.struct("lid", *values)
        now = now.groupBy("component", "root").agg(F.min(row).alias("a"), F.max(row).alias("b"))
        na, nb = F.col("a.n"), F.col("b.n")
        gap = F.lit(0.0)
        for c in names:
            gap = gap + (F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}"))
        new = {"n": na + nb, "sse": F.col("a.sse") + F.col("b.sse") + na * nb / (na + nb) * gap}
        new |= {c: (na * F.col(f"a.{c}") + nb * F.col(f"b.{c}")) / (na + nb) for c in names}
        single = F.col("a.lid") == F.col("b.lid")
        state = cut(now.select("component", F.col("root").alias("lid"), *[F.when(single, F.col(f"a.{c}")).otherwise(new[c]).alias(c) for c in values]))
    return connected_components(merges, "lid", "other").select(F.col("node").alias("__leaf"), F.col("component").alias("root"))


def _whole(batches, keys: list[str], columns: list[str], with_key: bool = False):
    """The columns' arrays of each group of a stream sorted by ``keys``, group by group."""
    now, held = None, []

    def joined():
        got = [np.concatenate(x) for x in zip(*held)] if len(held) > 1 else held[0]
        return (now[0], got) if with_key else got

    for b in batches:
        if not len(b):
            continue
        key = [b[k].to_numpy() for k in keys]
        data = [b[c].to_numpy() for c in columns]
        turns = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        edges = [0, *turns.tolist(), len(b)]
        for i, j in zip(edges[:-1], edges[1:]):
            this = tuple(k[i] for k in key)
            if held and this != now:
                yield joined()
                held = []
            now = this
            held.append([x[i:j] for x in data])
    if held:
        yield joined()


def _component_ward(rows: np.ndarray, width: int, radius: float, ids: np.ndarray | None = None) -> tuple[list, list]:
    """Per leaf the labels and centroids of all clusters that may be the nearest to a record in it."""
    n, ss, sums, keys = rows[:, 0], rows[:, 1], rows[:, 2 : 2 + width], rows[:, 2 + width :]
    total, middle = n.sum(), sums.sum(0) / n.sum()
    if 2 * (ss.sum() - total * (middle**2).sum()) <= (WARD_SHARE * radius) ** 2 * max(1, total - 1):
        return [np.zeros(1, np.int64)] * len(n), [middle] * len(n)  # the agglomeration may go all the way
    mean = sums / n[:, None]
    label = _ward(n, mean, np.maximum(0, ss - (sums**2).sum(1) / n), (WARD_SHARE * radius) ** 2, ids)
    cn = np.bincount(label, n)
    cent = np.column_stack([np.bincount(label, sums[:, j]) for j in range(width)]) / cn[:, None]
    return _nearest_cents(mean, keys, cent, radius)


def _nearest_cents(mean: np.ndarray, keys: np.ndarray, cent: np.ndarray, radius: float, halo: float = np.inf) -> tuple[list, list]:
    """Per leaf the places and values of the centroids that may be nearest to a record in it, or None where ones beyond ``halo`` may be."""
    # no record is farther from its leaf's mean than the corners of its cell, widened by the threshold
    side, over = radius / SPLIT * (1 + 1e-6), ABSORB * radius * (1 + 1e-6)
    corner = np.maximum(mean - (keys - 0.5) * side, (keys + 0.5) * side - mean) + over
    reach = np.sqrt((corner**2).sum(1)) + 1e-12 * np.abs(mean).max(1)
    order, seen = np.arange(len(mean)), np.arange(len(cent))
    if np.isfinite(halo):  # rows that are compared at once lie together
        order = np.lexsort(np.floor(mean[:, :GRID_DIMS] / radius).T)
    cands, cents = [None] * len(mean), [None] * len(mean)
    for i in range(0, len(mean), 256):
        at = order[i : i + 256]
        if np.isfinite(halo):
            seen = np.flatnonzero(((cent >= mean[at].min(0) - halo) & (cent <= mean[at].max(0) + halo)).all(1))
        if not len(seen):
            continue
        d = np.zeros((len(at), len(seen)))
        for c in range(mean.shape[1]):
            d += (mean[at, c, None] - cent[None, seen, c]) ** 2
        d = np.sqrt(d)
        most = (d.min(1) + 2 * reach[at]) * (1 + 1e-9)
        for k, row, sure in zip(at, d <= most[:, None], most <= halo):
            if sure:
                cands[k] = seen[row]
                cents[k] = cent[seen[row]].ravel()
    return cands, cents


def _ward(n: np.ndarray, mean: np.ndarray, sse: np.ndarray, most: float, ids: np.ndarray | None = None) -> np.ndarray:
    """Labels of a Ward agglomeration that keeps each cluster's mean square pair distance below ``most``.

    In each round all pairs merge that are each other's cheapest partner; of equal
    costs a hash of the two ``ids`` decides. So a round asks for nothing but what is in
    reach of a cluster, and gives the same by one task as by tiles.
    """
    n, mean, sse = n.astype(float), mean.astype(float), sse.astype(float)
    ids = np.arange(len(n)) if ids is None else ids
    member, partner, todo = np.arange(len(n)), np.full(len(n), -1), np.arange(len(n))
    while len(n) > 1:
        partner[todo] = _partners(n, mean, sse, ids, most, todo)
        a = np.flatnonzero(partner >= 0)
        a = a[(partner[partner[a]] == a) & (ids[a] < ids[partner[a]])]
        if not len(a):
            break
        b = partner[a]
        touched = [mean[a], mean[b]]
        na, nb = n[a], n[b]
        gap = np.zeros(len(a))
        for c in range(mean.shape[1]):
            gap += (mean[a, c] - mean[b, c]) ** 2
        sse[a] = sse[a] + sse[b] + na * nb / (na + nb) * gap
        mean[a] = (na[:, None] * mean[a] + nb[:, None] * mean[b]) / (na + nb)[:, None]
        n[a] = na + nb
        touched = np.concatenate([*touched, mean[a]])
        keep = np.ones(len(n), bool)
        keep[b] = False
        place = np.cumsum(keep) - 1
        place[b] = place[a]
        member = place[member]
        partner = np.where(partner >= 0, place[partner], -1)[keep]
        n, mean, sse, ids = n[keep], mean[keep], sse[keep], ids[keep]
        todo = np.arange(len(n)) if len(n) <= WARD_LEAVES else _in_reach(mean, touched, WARD_FAR * np.sqrt(most))
    return np.unique(member, return_inverse=True)[1].ravel()


def _partners(n: np.ndarray, mean: np.ndarray, sse: np.ndarray, ids: np.ndarray, most: float, rows: np.ndarray) -> np.ndarray:
    """The place of the cheapest partner of each of ``rows``, or -1 where no merge is allowed."""
    far = WARD_FAR * np.sqrt(most)

    def costs(i, j):
        d2 = 0.0
        for c in range(mean.shape[1]):
            d2 = d2 + (mean[i, c] - mean[j, c]) ** 2
        cost = n[i] * n[j] / (n[i] + n[j]) * d2
        ok = (d2 <= far * far) & (2 * (sse[i] + sse[j] + cost) <= most * np.maximum(1, n[i] + n[j] - 1)) & (i != j)
        return np.where(ok, cost, np.inf)

    out, best, second = np.full(len(rows), -1), np.full(len(rows), np.inf), np.zeros(len(rows), np.uint64)

    def take(at, j, cost):
        """Compare with the best so far; ``at`` ascends."""
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        least = np.repeat(np.minimum.reduceat(cost, first), np.diff(np.r_[first, len(at)]))
        ok = (cost == least) & (cost <= best[at]) & np.isfinite(cost)
        at, j, cost = at[ok], j[ok], cost[ok]
        tie = _pair_hash(ids[rows[at]], ids[j])
        order = np.lexsort((tie, at))
        at, j, cost, tie = at[order], j[order], cost[order], tie[order]
        ok = np.r_[True, at[1:] != at[:-1]][: len(at)]
        ok &= (cost < best[at]) | (tie < second[at])
        out[at[ok]], best[at[ok]], second[at[ok]] = j[ok], cost[ok], tie[ok]

    if len(n) <= WARD_LEAVES:
        if len(rows):
            cost = costs(rows[:, None], np.arange(len(n))[None])
            j, least = cost.argmin(1), cost.min(1)
            out = np.where(np.isfinite(least), j, -1)
            equal = cost == least[:, None]
            if (tied := (equal.sum(1) > 1) & (out >= 0)).any():
                at, j = np.nonzero(equal & tied[:, None])
                take(at, j, cost[at, j])
        return out
    left, width = np.arange(len(rows)), far / 8
    while len(left):
        cell = np.floor(mean[:, :GRID_DIMS] / width)
        key = _cell_hash(cell)
        order = np.argsort(key, kind="stable")
        known, start, size = np.unique(key[order], return_index=True, return_counts=True)
        left = left[np.argsort(key[rows[left]], kind="stable")]
        ask, which = np.unique(key[rows[left]], return_index=True, return_inverse=True)[1:]
        for o in itertools.product((-1.0, 0.0, 1.0), repeat=cell.shape[1]):
            want = _cell_hash(cell[rows[left[ask]]] + o)
            to = np.minimum(np.searchsorted(known, want), len(known) - 1)
            has = np.where(known[to] == want, size[to], 0)[which]
            begin, run = start[to][which], np.r_[0, np.cumsum(has)]
            i = 0
            while i < len(left):
                j = max(i + 1, int(np.searchsorted(run, run[i] + WARD_PAIRS, "right")) - 1)
                total = run[j] - run[i]
                if total:
                    at = np.repeat(np.arange(i, j), has[i:j])
                    other = order[begin[at] + np.arange(total) - (run[at] - run[i])]
                    sort = np.argsort(left[at], kind="stable")
                    at, other = left[at][sort], other[sort]
                    take(at, other, costs(rows[at], other))
                i = j
        # a partner that was not seen is farther than the width
        if width >= far:
            break
        left = left[best[left] >= n[rows[left]] / (n[rows[left]] + 1) * width * width * (1 - 1e-9)]
        width = min(2 * width, far * (1 + 1e-9))
    return out


def _in_reach(mean: np.ndarray, touched: np.ndarray, far: float) -> np.ndarray:
    """Places of the clusters in cells next to those of what a round has changed."""
    cell = np.unique(np.floor(touched[:, :GRID_DIMS] / far), axis=0)
    near = np.unique(np.concatenate([_cell_hash(cell + o) for o in itertools.product((-1.0, 0.0, 1.0), repeat=cell.shape[1])]))
    return np.flatnonzero(np.isin(_cell_hash(np.floor(mean[:, :GRID_DIMS] / far)), near))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same number for (a, b) and (b, a)."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    return _mixed(_mixed(low) + high)


def _cell_hash(cell: np.ndarray) -> np.ndarray:
    """A number per cell; where two share one, pairs too far apart are compared as well."""
    h = np.zeros(len(cell), np.uint64)
    for c in range(cell.shape[1]):
        h = _mixed(h + np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(cell[:, c] + 0.0).view(np.uint64))
    return h


def _component_cliques(x, n, vid, label, radius, min_size) -> np.ndarray:
    """cluster_id per vector, or _NONE: greedy choice of the largest maximal cliques."""
    m = len(x)
    out = np.full(m, _NONE, np.int64)
    rows = np.zeros((m, (m + 7) // 8), np.uint8)
    for i in range(0, m, 512):
        s = np.zeros((min(512, m - i), m))
        for c in range(x.shape[1]):
            s += (x[i : i + 512, c, None] - x[None, :, c]) ** 2
        rows[i : i + 512] = np.packbits(np.sqrt(s) <= radius, axis=1)
    view = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, twin = np.unique(view, return_index=True, return_inverse=True)
    twin = twin.ravel()
    k = len(first)
    weight = np.bincount(twin, n).astype(np.int64)
    low = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(low, twin, vid)
    links = []  # neighbours of each class of twins as a bit mask
    for c in range(k):
        near = np.unpackbits(rows[first[c]], count=m).astype(bool)
        mask = 0
        for t in np.unique(twin[near]):
            mask |= 1 << int(t)
        links.append(mask & ~(1 << c))
    found = _maximal(links, k)
    if found is None:
        for mask in _best_cliques(links, weight, low, _grown(links, weight, twin, label), min_size):
            members = [c for c in range(k) if mask >> c & 1]
            out[np.isin(twin, members)] = low[members].min()
        return out
    sized = []
    for mask in found:
        members = [c for c in range(k) if mask >> c & 1]
        size = int(weight[members].sum())
        if size >= min_size:
            sized.append((-size, int(low[members].min()), mask, members))
    sized.sort(key=lambda s: s[:2])
    taken = 0
    for _, tied in itertools.groupby(sized, key=lambda s: s[:2]):
        tied = list(tied)
        if len(tied) > 1:  # the smallest id that not all of them have decides
            tied.sort(key=lambda s: sorted(low[s[3]]))
        for _, small, mask, members in tied:
            if mask & taken:
                continue
            taken |= mask
            out[np.isin(twin, members)] = small
    return out


def _maximal(links: list[int], k: int) -> list[int] | None:
    """All maximal cliques by pivoting, or None beyond CLIQUE_STEPS steps."""
    out, steps, stack = [], 0, [(0, (1 << k) - 1, 0)]
    while stack:
        r, p, x = stack.pop()
        steps += 1
        if steps > CLIQUE_STEPS:
            return None
        if not p and not x:
            out.append(r)
            continue
        best, pivot, rest = -1, 0, p | x
        while rest:
            bit = rest & -rest
            rest ^= bit
            u = bit.bit_length() - 1
            c = (p & links[u]).bit_count()
            if c > best:
                best, pivot = c, u
        todo = p & ~links[pivot]
        while todo:
            bit = todo & -todo
            todo ^= bit
            v = bit.bit_length() - 1
            stack.append((r | bit, p & links[v], x & links[v]))
            p ^= bit
            x |= bit
    return out


def _best_cliques(links: list[int], weight: np.ndarray, low: np.ndarray, grown: list[int], min_size: int) -> list[int]:
    """The cliques that are chosen of all maximal ones, the best first, without listing all.

    ``grown`` are some maximal cliques, which give the first bounds. The search
    is exact whatever they are, and has no limit of steps.
    """
    order = [int(c) for c in np.argsort(low)]  # the smallest id first, so that the lowest bit that differs decides ties
    place = {c: i for i, c in enumerate(order)}

    def turned(mask: int, to) -> int:
        out = 0
        while mask:
            bit = mask & -mask
            mask ^= bit
            out |= 1 << to[bit.bit_length() - 1]
        return out

    links, heavy = [turned(links[c], place) for c in order], [int(weight[c]) for c in order]
    grown = [turned(m, place) for m in grown]
    taken, out = 0, []
    while True:
        best = _best_clique(links, heavy, taken, [m for m in grown if not m & taken], min_size)
        if not best:
            return [turned(m, order) for m in out]
        taken |= best
        out.append(best)


def _best_clique(links: list[int], weight: list[int], taken: int, known: list[int], min_size: int) -> int:
    """Of the maximal cliques clear of ``taken`` the heaviest one, at equal weight
    that with the lowest bit the other lacks; 0 if none weighs ``min_size``."""
    best, most = 0, min_size

    def better(mask: int, size: int) -> bool:
        differ = mask ^ best
        return size > most or size == most and bool(mask & (differ & -differ))

    for mask in known:
        size = sum(w for i, w in enumerate(weight) if mask >> i & 1)
        if better(mask, size):
            best, most = mask, size
    stack = [(0, ((1 << len(links)) - 1) & ~taken, taken, 0)]
    while stack:
        r, p, x, size = stack.pop()
        if not p:
            if not x and better(r, size):
                best, most = r, size
            continue
        rest, closed = x, False
        while rest and not closed:  # what is linked to all of r and p extends every clique from here
            bit = rest & -rest
            rest ^= bit
            closed = not p & ~links[bit.bit_length() - 1]
        if closed:
            continue
        # vertices of one colour exclude each other, so the heaviest of each colour bound the weight
        bounds, left, bound = [], p, size
        while left:
            free, top = left, 0
            colour = []
            while free:
                bit = free & -free
                v = bit.bit_length() - 1
                free &= ~(bit | links[v])
                left ^= bit
                top = max(top, weight[v])
                colour.append(v)
            bound += top
            bounds += [(bound, v) for v in colour]
        branches = []
        for bound, v in reversed(bounds):  # vertices before this one weigh no more than bound
            if not better(r | p, bound):
                break
            bit = 1 << v
            branches.append((r | bit, p & links[v], x & links[v], size + weight[v]))
            p ^= bit
            x |= bit
        stack += reversed(branches)
    return best


def _grown(links: list[int], weight: np.ndarray, twin: np.ndarray, label: np.ndarray) -> list[int]:
    """One maximal clique per Ward cluster, grown from its heaviest classes."""
    out = []
    for c in np.unique(label):
        seeds = np.unique(twin[label == c])
        allowed = -1
        mask = 0
        order = sorted(map(int, seeds), key=lambda t: -int(weight[t])) + sorted(range(len(links)), key=lambda t: -int(weight[t]))
        for t in order:
            if not mask >> t & 1 and allowed >> t & 1:
                mask |= 1 << t
                allowed &= links[t] | mask
        out.append(mask)
    return out

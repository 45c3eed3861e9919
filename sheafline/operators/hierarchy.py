"""Parent-child links to full hierarchies, with cycles told.

Bottom-up leaf peeling: in every round the nodes without remaining children
leave and send their subtree sizes to their parents. What remains is closed
upwards, so once it fits one task (a checked bound) it is finished there; then
the peel order runs in reverse and each round's nodes take path, depth and root
from their parents. Nodes that never become leaves lie on cycles. Where peeling
hardly shrinks the rest (very long chains) pointer doubling finishes it in a
logarithmic number of rounds instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join

#: The rest of the nodes that one task may finish; it holds a few numbers for
#: each, and the elements of paths it holds at a time.
LOCAL_LIMIT, PATH_ELEMENTS = 10_000, 1_000_000
#: Peeling goes on while a round removes at least this share of the rest.
MIN_SHRINK = 0.05



def hierarchy(df: DataFrame, node: str, parent: str, local_limit: int = LOCAL_LIMIT, paths: bool = True) -> DataFrame:
    """One row per node: (node, parent, root, depth, cyclic, path, subtree_size).

    Without ``paths`` the last two are left out, and with them all that grows
    with the depth of the trees.
    ``path`` runs from the root to the node itself. A parent that is null or
    not itself a node ends the chain: the node is a root of depth 0 with
    ``parent`` null. For a chain that never ends ``cyclic`` is 1, ``root`` the
    smallest node on the cycle, ``depth`` the steps to the first node on it (0
    on the cycle) and ``path`` starts at that node; a node that is its own
    parent is a cycle. ``subtree_size`` counts the node and all below it; on a
    cycle it counts the node and the trees hanging on it, not the other nodes
    of the cycle. Rows with a null node are ignored; of several rows for one
    node the smallest non-null parent holds. An empty table gives no rows.
    Other columns are ignored.
    """
    links = (
        df.where(F.col(f"`{node}`").isNotNull())
        .groupBy(F.col(f"`{node}`").alias("node"))
        .agg(F.min(f"`{parent}`").alias("parent"))
    )
    links = cut(links)
    known = links.select(F.col("node").alias("__p"))
    links = lookup_join(links, known, "parent", "__p").select("node", F.col("__p").alias("parent"), *([F.lit(1).cast("long").alias("subtree_size")] if paths else []))
    rest = cut(links)
    peeled: list[DataFrame] = []
    n = rest.count()
    shrinking = True
    while n > local_limit and shrinking:
        below = rest.where("parent is not null").groupBy(F.col("parent").alias("__p")).agg(F.lit(True).alias("__has"))
        marked = cut(rest.join(below, F.col("node") == F.col("__p"), "left").select(*rest.columns, F.col("__has").isNull().alias("__leaf")))
        leaves = marked.where("__leaf").drop("__leaf")
        gone = leaves.count()
        if not gone:
            break
        rest = marked.where("not __leaf").drop("__leaf")
        if paths:
            sent = leaves.where("parent is not null").groupBy(F.col("parent").alias("__p")).agg(F.sum("subtree_size").alias("__s"))
            size = (F.col("subtree_size") + F.coalesce("__s", F.lit(0))).alias("subtree_size")
            rest = cut(rest.join(sent, F.col("node") == F.col("__p"), "left").select("node", "parent", size))
        peeled.append(leaves)
        shrinking = gone >= MIN_SHRINK * n
        n -= gone
    kind = dict(rest.dtypes)["node"]
    solved = _finish_local(rest, kind, paths) if n <= local_limit else _finish_doubling(rest, paths)
    solved = cut(solved) if peeled else solved
    for leaves in reversed(peeled):
        up = solved.select(
            F.col("node").alias("__p"),
            F.col("root").alias("__root"),
            F.col("depth").alias("__depth"),
            F.col("cyclic").alias("__cyclic"),
            *([F.col("path").alias("__path")] if paths else []),
        )
        isolated = F.col("parent").isNull()
        down = lookup_join(leaves, up, "parent", "__p").select(
            "node",
            "parent",
            F.when(isolated, F.col("node")).otherwise(F.col("__root")).alias("root"),
            F.when(isolated, F.lit(0)).otherwise(F.col("__depth") + 1).cast("int").alias("depth"),
            F.when(isolated, F.lit(0)).otherwise(F.col("__cyclic")).cast("int").alias("cyclic"),
            *([F.when(isolated, F.array("node")).otherwise(F.concat("__path", F.array("node"))).alias("path"), "subtree_size"] if paths else []),
        )
        solved = cut(solved.unionByName(down))
    return solved


def descendants(tree: DataFrame) -> DataFrame:
    """Long form of all (ancestor, descendant, distance) of a :func:`hierarchy`.

    A node with any number of descendants has that many rows, never one list.
    Nodes on a cycle have no ancestors here; the cycle is told by ``cyclic``.
    """
    steps = tree.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("__i", "ancestor"))
    return steps.where(F.col("__i") < F.col("depth")).select(
        "ancestor", "descendant", (F.col("depth") - F.col("__i")).cast("int").alias("distance")
    )


def _finish_local(rest: DataFrame, kind: str, paths: bool) -> DataFrame:
    """Peel and solve a rest of at most ``local_limit`` nodes in one task.

    Only depth, root and size are kept for each node; paths are walked when
    rows are given out, so many at a time as PATH_ELEMENTS allows.
    """
    schema = f"node {kind}, parent {kind}, root {kind}, depth int, cyclic int" + (f", path array<{kind}>, subtree_size long" if paths else "")

    def solve(batches):
        frames = list(batches)
        if not frames:
            return
        got = pd.concat(frames, ignore_index=True)
        parent = {a: (None if pd.isna(b) else b) for a, b in zip(got["node"], got["parent"])}
        size = dict(zip(got["node"], map(int, got["subtree_size"]))) if paths else {}
        waiting = dict.fromkeys(parent, 0)
        for b in parent.values():
            if b is not None:
                waiting[b] += 1
        order, now = [], [a for a, w in waiting.items() if not w]
        while now:
            after = []
            for a in now:
                order.append(a)
                b = parent[a]
                if b is not None:
                    if paths:
                        size[b] += size[a]
                    waiting[b] -= 1
                    if not waiting[b]:
                        after.append(b)
            now = after
        done = {}
        peeled = set(order)
        for a in parent:
            if a in peeled or a in done:
                continue
            ring, x = [], a
            while not ring or x != a:
                ring.append(x)
                x = parent[x]
            low = min(ring)
            for x in ring:
                done[x] = (low, 0, 1)
        for a in reversed(order):
            b = parent[a]
            done[a] = (a, 0, 0) if b is None else (done[b][0], done[b][1] + 1, done[b][2])
        rows, held = [], 0
        columns = ["node", "parent", "root", "depth", "cyclic", *(["path", "subtree_size"] if paths else [])]

        def frame():
            out = pd.DataFrame(rows, columns=columns)
            for c in ("node", "parent", "root"):
                out[c] = out[c].astype(got["node"].dtype if c != "parent" else object)
            return out

        for a in parent:
            row = (a, parent[a], *done[a])
            if paths:
                path = [a]
                for _ in range(done[a][1]):
                    path.append(parent[path[-1]])
                row += (path[::-1], size[a])
                held += len(path)
            rows.append(row)
            if held >= PATH_ELEMENTS or len(rows) >= 5_000:
                yield frame()
                rows, held = [], 0
        if rows:
            yield frame()

    return rest.coalesce(1).mapInPandas(_plain_ints(solve), schema)


def _plain_ints(solve):
    """Parents arrive as floats where some are null; give whole numbers back."""

    def run(batches):
        def fixed():
            for b in batches:
                if b["parent"].dtype.kind == "f" and b["node"].dtype.kind == "i":
                    b = b.assign(parent=b["parent"].astype("Int64").astype(object).where(b["parent"].notna(), None))
                yield b

        yield from solve(fixed())

    return run


def _finish_doubling(rest: DataFrame, paths: bool) -> DataFrame:
    """Solve any rest in about log2(longest chain or cycle) rounds of self-joins each."""
    jump = rest.select("node", F.col("parent").alias("nxt"))
    # the nodes reached after 2^k steps become fewer until only cycles are left
    reached = -1
    while True:
        seen = jump.where("nxt is not null").agg(F.countDistinct("nxt"), F.count("nxt")).first()
        if not seen[1] or tuple(seen) == reached:
            break
        reached = tuple(seen)
        far = jump.select(F.col("node").alias("__a"), F.col("nxt").alias("__n"))
        jump = cut(jump.join(far, F.col("nxt") == F.col("__a"), "left").select("node", F.col("__n").alias("nxt")))
    on_cycle = cut(jump.where("nxt is not null").select(F.col("nxt").alias("__c")).distinct())
    marked = cut(rest.join(on_cycle, F.col("node") == F.col("__c"), "left").withColumn("__on", F.col("__c").isNotNull()).drop("__c"))
    ring = marked.where("__on").select("node", F.col("parent").alias("nxt"), F.col("node").alias("low"))
    # the smallest node of 2^k steps; it stays as it is once all of the cycle is seen
    changed = not on_cycle.isEmpty()
    while changed:
        far = ring.select(F.col("node").alias("__a"), F.col("nxt").alias("__n"), F.col("low").alias("__l"))
        both = cut(ring.join(far, F.col("nxt") == F.col("__a")).select("node", F.col("__n").alias("nxt"), F.least("low", "__l").alias("low"), F.col("low").alias("__old")))
        changed = not both.where("low <> __old").isEmpty()
        ring = both.drop("__old")
    top = marked.withColumn("up", F.when(~F.col("__on"), F.col("parent")))
    if not paths:
        return _tops(top).join(ring.select(F.col("node").alias("__r"), F.col("low").alias("__low")), F.col("top") == F.col("__r"), "left").select(
            "node", "parent", F.coalesce("__low", "top").alias("root"), F.col("steps").alias("depth"), F.col("__low").isNotNull().cast("int").alias("cyclic")
        )
    walk = cut(
        top.select(
            "node",
            F.col("up").alias("nxt"),
            F.coalesce("up", "node").alias("top"),
            F.when(F.col("up").isNull(), F.array().cast(f"array<{dict(rest.dtypes)['node']}>")).otherwise(F.array("up")).alias("ups"),
        )
    )
    while not walk.where("nxt is not null").isEmpty():
        far = walk.select(F.col("node").alias("__a"), F.col("nxt").alias("__n"), F.col("top").alias("__t"), F.col("ups").alias("__u"))
        walk = cut(
            walk.join(far, F.col("nxt") == F.col("__a"), "left").select(
                "node",
                F.col("__n").alias("nxt"),
                F.coalesce("__t", "top").alias("top"),
                F.when(F.col("__u").isNull(), F.col("ups")).otherwise(F.concat("ups", "__u")).alias("ups"),
            )
        )
    # subtree sizes: own weight counted once at every ancestor and at itself
    weights = marked.select("node", F.col("subtree_size").alias("__w"))
    up = walk.join(weights, "node").select(F.explode(F.concat(F.array("node"), "ups")).alias("node"), "__w")
    sizes = up.groupBy("node").agg(F.sum("__w").alias("subtree_size"))
    low = ring.select(F.col("node").alias("__r"), F.col("low").alias("__low"))
    return (
        walk.join(marked.select("node", "parent"), "node")
        .join(sizes, "node")
        .join(low, F.col("top") == F.col("__r"), "left")
        .select(
            "node",
            "parent",
            F.coalesce("__low", "top").alias("root"),
            F.size("ups").cast("int").alias("depth"),
            F.col("__low").isNotNull().cast("int").alias("cyclic"),
            F.concat(F.reverse("ups"), F.array("node")).alias("path"),
            "subtree_size",
        )
    )


def _tops(links: DataFrame) -> DataFrame:
    """(node, parent, top, steps) of rows with the next node ``up``: where the chain ends, after how many steps."""
    walk = cut(links.select("node", "parent", F.col("up").alias("nxt"), F.coalesce("up", "node").alias("top"), F.col("up").isNotNull().cast("int").alias("steps")))
    while not walk.where("nxt is not null").isEmpty():
        far = walk.select(F.col("node").alias("__a"), F.col("nxt").alias("__n"), F.col("top").alias("__t"), F.col("steps").alias("__s"))
        walk = cut(
            walk.join(far, F.col("nxt") == F.col("__a"), "left").select(
                "node", "parent", F.col("__n").alias("nxt"), F.coalesce("__t", "top").alias("top"), (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps")
            )
        )
    return walk.select("node", "parent", "top", "steps")

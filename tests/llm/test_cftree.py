import numpy as np
import pytest

from sheafline.llm.cftree import CFTree, _Leaf


def nodes(node, depth=0):
    yield node, depth
    for kid in [] if isinstance(node, _Leaf) else node.kids:
        yield from nodes(kid, depth + 1)


@pytest.mark.parametrize("block, branching", [(1, 4), (50, 4), (700, 8), (5000, 32)])
def test_tree(block, branching):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.normal(c, 0.2, (100, 3)) for c in rng.uniform(-3, 3, (10, 3))] + [np.full((20, 3), 7.0), [[1e30, -1e30, 0.0]]])
    rng.shuffle(x)
    tree = CFTree(0.1, branching)
    first = np.concatenate([tree.insert(x[i : i + block]) for i in range(0, len(x), block)])
    assert np.sqrt(((first - x) ** 2).sum(1)).max() <= 0.1
    held = [n for n, _ in nodes(tree.root) if isinstance(n, _Leaf)]
    assert all(len(n.first) <= branching for n in held) and all(len(n.kids) <= branching for n, _ in nodes(tree.root) if not isinstance(n, _Leaf))
    assert sum(n.count.sum() for n in held) == len(x) and tree.entries == sum(len(n.first) for n in held)
    count, total = {}, {}
    for n in held:  # copies in different nodes begin entries alike
        for f, c, t in zip(n.first, n.count, n.total):
            count[tuple(f)], total[tuple(f)] = count.get(tuple(f), 0) + c, total.get(tuple(f), 0) + t
    for f in np.unique(first, axis=0):
        mine = (first == f).all(1)
        assert count[tuple(f)] == mine.sum() and np.allclose(total[tuple(f)], x[mine].sum(0))
    assert tree.entries < len(x)


def test_a_full_tree_is_closed():
    x = np.random.default_rng(0).uniform(0, 100, (300, 2))
    tree = CFTree(0.01, 4, most=50)
    first = np.concatenate([tree.insert(x[i : i + 30]) for i in range(0, 300, 30)])
    assert (first == x).all() and tree.entries <= 80
    assert len(tree.insert(x[:0])) == 0

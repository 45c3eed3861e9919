import random

import numpy as np
import pytest

from sheafline.llm import leakage
from sheafline.llm.leakage import leaked_items, words_of

WORDS = [a + b for a in "bcdfghjklm" for b in ("ax", "ex", "ix", "oz")]


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as passage", "2 as run").repartition(3)
    i = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "1 as doc_id", "'y' as text")
    return leaked_items(d, "doc_id", "text", i, "item_id", "passage")


def longest(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = last[j] + 1
                best = max(best, now[j + 1])
        last = now
    return best


def test_words():
    assert words_of("It's A+B_c\n> Café 12x") == [b"it", b"s", b"a", b"b", b"c", b"caf", b"x"]


@pytest.mark.parametrize("block", [2_000, 3])
def test_long_runs_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", block)
    rng = random.Random(block)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [rng.choice(["the", "of", "zzz", *WORDS[:4]]) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split()
            k = rng.randint(1, len(w))
            at = rng.randrange(len(w) - k + 1)
            text[len(text) // 2 : len(text) // 2] = [x.upper() if rng.random() < 0.3 else x for x in w[at : at + k]]
        docs.append((d, ("\n+ " if d % 2 else ", ").join(text)))
    got = {(r["doc_id"], r["item_id"]): r["run"] for r in run(spark, docs, items).collect()}
    split = {i: words_of(t) for i, t in items}
    for d, t in docs:
        for i, p in split.items():
            n = longest(words_of(t), p)
            if n >= 12 or n == len(p) >= leakage.GRAM:
                assert got[d, i] == n
            elif (d, i) in got:
                assert got[d, i] == n


def test_edited_copies_score(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    edited = "x one two three four five SIX extra seven eight nine changed eleven twelve thirteen fourteen y"
    r = run(spark, [(1, edited), (2, "nothing here at all")], [(5, item)]).collect()
    assert [(x["doc_id"], x["item_id"], x["run"]) for x in r] == [(1, 5, 6)]
    assert r[0]["score"] == 2 * 13 - 1 - 1 and r[0]["item_words"] == 14


def test_edited_copies_beside_verbatim_ones(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(6, 40)))) for i in range(15)]
    items += [(20 + i, " ".join([*rng.choices(WORDS[:3], k=8), *rng.choices(WORDS, k=rng.randint(0, 9))])) for i in range(5)]
    docs = [(1000 + i, f"before {p} after") for i, p in items]  # these make intact n-grams the common ones
    for d in range(150):
        text = rng.choices(["the", "of", *WORDS], k=rng.randint(0, 80))
        words = rng.choice(items)[1].split()
        every = rng.choice([2, 3, 4, 5, 8])
        edit = rng.choice([lambda w: ["zzz"], lambda w: [], lambda w: [w, "zzz"], lambda w: [w, rng.choice(WORDS)]])
        copy = [x for k, w in enumerate(words) for x in (edit(w) if k % every == every - 1 else [w])]
        if rng.random() < 0.2:
            copy = [x for w in words for x in (w, "zzz")]  # no two words of the item in a row
        if d % 10 == 0:
            text = ["far"] * 500 + text
        docs.append((d, " ".join(text[: len(text) // 2] + copy + text[len(text) // 2 :])))
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["run"]) for r in run(spark, docs, items).collect()}
    names = {w: k for k, w in enumerate(sorted({w for _, t in docs + items for w in t.split()}))}
    number = lambda t: np.array([names[w] for w in t.split()])
    expected = 0
    for i, p in items:
        score, longest_run = leakage._smith_waterman([number(t) for _, t in docs], [number(p)] * len(docs))
        for (d, _), s, r in zip(docs, score, longest_run):
            if s >= len(p.split()):
                expected += 1
                assert got[d, i] == (s, r)
    assert expected > 150


def test_smith_waterman_equals_plain():
    rng = np.random.default_rng(0)
    texts = [rng.integers(-1, 5, rng.integers(5, 40)).astype(np.int32) for _ in range(20)]
    items = [rng.integers(0, 5, rng.integers(5, 20)) for _ in range(20)]
    score, run_ = leakage._smith_waterman(texts, items)
    for k, (a, b) in enumerate(zip(texts, items)):
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(len(b)):
            for j in range(len(a)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[j] == b[i] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert score[k] == h.max() and run_[k] == longest(list(a), list(b))


def test_dirt(spark):
    long = "filler " * 200_000 + "p q r s t u v w x y z a b"
    docs = [(1, None), (2, ""), (None, "p q r s t u v w x y z a b"), (3, long), (3, long), (4, "日本語 " * 50)]
    items = [(7, "P. Q. R. S. T. U. V. W. X. Y. Z. A. B."), (8, None), (None, "p q r s t u v w x y"), (9, ""), (10, "p q")]
    assert [(r[0], r[1], r["run"]) for r in run(spark, docs, items).collect()] == [(3, 7, 13)]
    assert run(spark, [], items).count() == 0 == run(spark, docs, []).count()


@pytest.mark.parametrize("share", [0.1, 0.15, 0.2, 0.25, 0.3])
def test_recall_of_edited_copies(spark, share):
    """All pairs whose true alignment reaches the bound, whatever share of the words is replaced."""
    rng = random.Random(int(share * 100))
    items = [(i, " ".join(rng.choices([f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(8)], k=40))) for i in range(10)]
    docs = []
    for d in range(200):
        words = [f"other{chr(97 + rng.randrange(26))}" if rng.random() < share else w for w in rng.choice(items)[1].split()]
        docs.append((d, " ".join([*rng.choices(WORDS, k=30), *words, *rng.choices(WORDS, k=30)])))
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, docs, items).collect() if r["score"] >= r["item_words"]}
    names = {w: k for k, w in enumerate(sorted({w for _, t in docs + items for w in t.split()}))}
    number = lambda t: np.array([names[w] for w in t.split()])
    true = set()
    for i, p in items:
        score, _ = leakage._smith_waterman([number(t) for _, t in docs], [number(p)] * len(docs))
        true |= {(d, i) for (d, _), s in zip(docs, score) if s >= 40}
    assert len(true) > 100 and got == true


def test_documents_full_of_hits_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SLICE", 50)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(8, 30)))) for i in range(6)]
    docs = [(d, " ".join(rng.choice(items)[1] if rng.random() < 0.8 else "zzz of " * rng.randint(1, 9) for _ in range(60))) for d in range(4)]
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["run"]) for r in run(spark, docs, items).collect()}
    for d, t in docs:
        for i, p in items:
            if p in t:
                assert got[d, i] == (2 * len(p.split()), longest(words_of(t), words_of(p)))


def test_slices_hold_every_alignment():
    for size, around in ((50, 7), (4096, 30), (10, 100)):
        for end in (1, 49, 50, 1000, 5000):
            parts = list(leakage._slices(0, end, around))
            assert parts[0][0] == 0 and parts[-1][1] == end
            for i in range(0, max(1, end - 3 * around), 7):
                assert any(a <= i and min(end, i + 3 * around) <= b for a, b in parts)

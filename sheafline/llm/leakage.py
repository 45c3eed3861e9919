"""Evaluation texts leaking into a corpus: rare n-gram seeds, then alignment.

One pass over the corpus finds where any n-gram of the items occurs and keeps
those passages as word numbers, long ones in slices that overlap by more than an
alignment can span. From the counts of all those n-grams over the whole corpus
every window of an item picks its rarest n-gram as seed; passages are joined to
items by seeds and scored by Smith-Waterman alignment over words, which also
gives the longest run of equal words. What tasks share of the items is bounded
by taking them in blocks, of which only very many items need more than one.

Edited copies need not share any n-gram, so they are found by a bound instead: a
score of at least the item's words takes so many of the item's words within so
few words of the document that counting them leaves few pairs to align.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join

#: Words of an n-gram; of an item's window; items and characters of a block.
GRAM, WINDOW = 5, 12
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
#: Words of documents aligned at once, unless one piece has more; words of a passage's slice.
BATCH_WORDS, SLICE = 100_000, 4_096
MATCH, MISMATCH, GAP = 2, -1, 1
#: Hits farther apart than this many words belong to different passages.
APART = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Any byte but a letter becomes a blank, letters become small.
_FOLD = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_OUT = "doc_id long, item_id long, score int, item_words int, run int, at int"


def words_of(text: str) -> list[bytes]:
    """The longest runs of letters a to z, case aside."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, item_words, run, at): best alignment per pair.

    A pair is reported if the document holds a seed of the item, that is, an
    n-gram of GRAM words; every run of WINDOW or more common words holds one,
    and so does any shorter item that occurs whole and has GRAM words. With
    ``edited`` every pair whose score reaches ``item_words`` is reported too,
    whether it shares an n-gram or not. ``score``
    is the Smith-Waterman score over words (MATCH, MISMATCH, GAP), at most
    MATCH times ``item_words``; ``run`` the longest run of equal words and
    ``at`` the word of the document where the best passage starts. Null or
    empty texts and items, and items under GRAM words, match nothing; rows with
    a null id are ignored; repeated items or documents give one row per id
    pair. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(
        "doc_id is not null and text is not null"
    )
    wanted = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{passage}`").alias("passage")).where(
        "item_id is not null and passage is not null"
    )
    out = spark.createDataFrame([], _OUT)
    for block in _blocks(wanted.distinct().orderBy("item_id").toLocalIterator()):
        out = out.unionByName(_block_matches(corpus, block, edited))
    best = F.max(F.struct("run", "score", (-F.col("at")).alias("back"))).alias("b")
    pairs = out.groupBy("doc_id", "item_id").agg(best, F.max("score").alias("score"), F.max("item_words").alias("item_words"))
    return pairs.select("doc_id", "item_id", "score", "item_words", F.col("b.run").alias("run"), (-F.col("b.back")).alias("at"))


def _blocks(rows):
    """Lists of (item_id, words), each within the bounds of a block."""
    block, chars = [], 0
    for r in rows:
        words = words_of(r["passage"])
        if len(words) < GRAM:
            continue
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r["passage"]) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], words))
        chars += len(r["passage"])
    if block:
        yield block


def _grams(ids: np.ndarray) -> np.ndarray:
    """One number per n-gram of consecutive words; equal n-grams have equal ones."""
    n = len(ids) - GRAM + 1
    code = np.zeros(max(0, n), np.uint64)
    for k in range(GRAM if n > 0 else 0):
        code = (code ^ ids[k : k + n].astype(np.uint64)) * _MULTIPLIER
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def _block_matches(corpus: DataFrame, block: list, edited: bool) -> DataFrame:
    spark = corpus.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
    coded = [(i, np.array([vocabulary[w] for w in words])) for i, words in block]
    known = np.unique(np.concatenate([_grams(a) for _, a in coded]))
    around = max(len(a) for _, a in coded)
    shared = spark.sparkContext.broadcast((vocabulary, known, around, coded, edited))  # bounded by the block
    passages = cut(corpus.mapInPandas(_scan(shared), f"{_OUT}, words array<int>, grams array<long>"))
    aligned = passages.where("item_id is not null").select("doc_id", "item_id", "score", "item_words", "run", "at")
    held = passages.where("item_id is null").select("doc_id", "at", "words", "grams")
    where = held.select("doc_id", "at", F.explode("grams").alias("g"))
    counts = where.groupBy("g").agg(F.count("*").alias("n"))
    # the places of the block in order, a few numbers a task; each task forms its items' n-grams
    places = spark.range(len(coded)).mapInPandas(_windows(shared), "pos int, at int, gram long")
    counted = places.join(counts, F.col("gram") == F.col("g")).groupBy("pos").agg(F.collect_list(F.struct("at", "gram", "n")).alias("found"))
    seeds = counted.mapInPandas(_seeds(shared), "gram long, pos int").distinct().groupBy("gram").agg(F.collect_list("pos").alias("items"))
    hits = lookup_join(where, cut(seeds), "g", "gram", "inner").select("doc_id", "at", F.explode("items").alias("pos"))
    wanted = hits.groupBy(F.col("doc_id").alias("__d"), F.col("at").alias("__a")).agg(F.collect_set("pos").alias("items"))  # items of one passage
    looked = held.select("doc_id", "at", "words").join(wanted, (F.col("doc_id") == F.col("__d")) & (F.col("at") == F.col("__a")))
    return looked.select("doc_id", "at", "words", "items").mapInPandas(_align(shared), _OUT).unionByName(aligned)


def _windows(shared):
    """Each n-gram of the items, by place."""

    def run(batches):
        coded = shared.value[3]
        for b in batches:
            some = [(pos, _grams(coded[pos][1])) for pos in b["id"]]
            yield pd.DataFrame(
                {
                    "pos": np.repeat([p for p, _ in some], [len(c) for _, c in some]).astype(np.int32),
                    "at": np.concatenate([*[np.arange(len(c)) for _, c in some], np.zeros(0)]).astype(np.int32),
                    "gram": np.concatenate([*[c for _, c in some], np.zeros(0, np.int64)]).astype(np.int64),
                }
            )

    return run


def _seeds(shared):
    """The rarest n-gram of every window of the items, of those that occur."""

    def run(batches):
        coded = shared.value[3]
        for b in batches:
            out = []
            for pos, found in zip(b["pos"], b["found"]):
                size = len(coded[pos][1]) - GRAM + 1
                grams, rarity = np.zeros(size, np.int64), np.full(size, 2**62)  # what never occurs is no seed
                for f in found:
                    grams[f["at"]], rarity[f["at"]] = f["gram"], f["n"]
                span = min(WINDOW - GRAM + 1, size)
                best = np.arange(size - span + 1) + np.lib.stride_tricks.sliding_window_view(rarity, span).argmin(1)
                out += [(int(g), pos) for g in np.unique(grams[best[rarity[best] < 2**62]])]
            yield pd.DataFrame(out, columns=["gram", "pos"])

    return run


class _Bound:
    """Pairs that may score at least the item's number of words n.

    Of m equal words and e others such a score has 2m - e >= n, so m >= n / 2;
    it spans at most m + e words of the document, so a span of s words takes
    m >= (n + s) / 3 and s <= 2n. The m equal words are words of the item, none
    more often than there.
    """

    def __init__(self, coded: list, size: int):
        self.names = [i for i, _ in coded]
        self.items = [a for _, a in coded]
        self.counts = [np.unique(a, return_counts=True) for a in self.items]
        self.half = np.array([-(-len(a) // 2) for a in self.items])
        # the k-th occurrence of a word is a feature; the items with it are listed
        most = np.zeros(size, np.int64)
        for w, c in self.counts:
            most[w] = np.maximum(most[w], c)
        self.most, self.base = most, np.cumsum(most) - most
        feature = np.concatenate([np.repeat(self.base[w], c) + _ranks(c) for w, c in self.counts])
        order = np.argsort(feature, kind="stable")
        self.holders = np.repeat(np.arange(len(coded)), [len(a) for a in self.items])[order].astype(np.int32)
        self.first = np.searchsorted(feature[order], np.arange(most.sum() + 1))

    def pairs(self, ids: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(item, word where the first window starts, words to align) for a document."""
        w, c = np.unique(ids[ids >= 0], return_counts=True)
        c = np.minimum(c, self.most[w])
        if c.sum() < self.half.min():
            return []
        feature = np.repeat(self.base[w], c) + _ranks(c)
        listed = self.first[feature + 1] - self.first[feature]
        shared = np.bincount(self.holders[np.repeat(self.first[feature], listed) + _ranks(listed)], minlength=len(self.items))
        out = []
        for pos in np.flatnonzero(shared >= self.half):
            found = self._windows(ids, int(pos))
            if found is not None:
                out.append((int(pos), *found))
        return out

    def _windows(self, ids: np.ndarray, pos: int) -> tuple[int, np.ndarray] | None:
        n, (words, counts) = len(self.items[pos]), self.counts[pos]
        place = np.minimum(np.searchsorted(words, ids), len(words) - 1)
        at = np.flatnonzero(words[place] == ids)
        # no alignment bridges more than 2n foreign words, so longer stretches shrink
        new = np.cumsum(np.minimum(np.diff(at, prepend=at[0] - 1), 2 * n + 1)) - 1
        order = np.argsort(place[at], kind="stable")
        word, spot = place[at][order], new[order]
        back = np.arange(len(word)) - counts[word]
        same = (back >= 0) & (word[back] == word)
        # starts of windows in which the item's count of the word is used up before this one
        used = np.where(same, spot[back] + 1, 0)
        best = None
        for span, least in ((n, -(-n // 2)), (n + n // 2, -(-2 * n // 3)), (2 * n, -(-5 * n // 6))):
            lo = np.maximum(used, spot - span + 1)
            ok = lo <= spot
            size = int(new[-1]) + 2
            held = np.cumsum(np.bincount(lo[ok], minlength=size) - np.bincount(spot[ok] + 1, minlength=size))
            start = np.flatnonzero(held >= least)
            if len(start):
                begin = int(at[np.searchsorted(new, start[0])])
                best = begin if best is None else min(best, begin)
        if best is None:
            return None
        text = np.full(int(new[-1]) + 1, -1, np.int32)
        text[new] = ids[at]
        return best, text

    def aligned(self, found: list) -> list[tuple]:
        """Rows of _OUT for (doc, item, at, words), in batches of bounded size."""
        found.sort(key=lambda f: (len(f[3]), f[0], f[1]))
        out = []
        for some in _batched(found):
            score, run = _smith_waterman([f[3] for f in some], [self.items[f[1]] for f in some])
            out += [(doc, self.names[p], s, len(self.items[p]), r, at) for (doc, p, at, _), s, r in zip(some, score, run) if s >= len(self.items[p])]
        return out


def _batched(found: list):
    """Rows that end with their words, shortest first, so many together as BATCH_WORDS allows."""
    some = []
    for k, f in enumerate(found):
        some.append(f)
        if k + 1 == len(found) or len(some) == 128 or len(found[k + 1][-1]) * (len(some) + 1) > BATCH_WORDS:
            yield some
            some = []


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _scan(shared):
    """Passages of each document around n-grams of the items, and the alignments of edited copies."""

    def run(batches):
        vocabulary, known, around, coded, edited = shared.value
        bound = _Bound(coded, len(vocabulary)) if edited else None
        get = vocabulary.get
        for b in batches:
            out, near = [], []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
                if bound is not None:
                    near += [(doc, *f) for f in bound.pairs(ids)]
                if len(ids) < GRAM:
                    continue
                miss = np.concatenate([[0], np.cumsum(ids < 0)])
                full = np.flatnonzero(miss[GRAM:] == miss[:-GRAM])
                if not len(full):
                    continue
                codes = _grams(ids)[full]
                place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[place] == codes
                at, codes = full[hit], codes[hit]
                if not len(at):
                    continue
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > APART) + 1):
                    lo, hi = max(0, at[part[0]] - around), at[part[-1]] + GRAM + around
                    for i, j in _slices(lo, min(hi, len(ids)), around):
                        inside = part[np.searchsorted(at[part], i) : np.searchsorted(at[part], j - GRAM, "right")]
                        if len(inside):
                            out.append((doc, i, ids[i:j].astype(np.int32), np.unique(codes[inside])))
            passages = pd.DataFrame(out, columns=["doc_id", "at", "words", "grams"])
            columns = ["doc_id", "item_id", "score", "item_words", "run", "at"]
            for c in columns[1:5]:
                passages[c] = pd.Series(pd.NA, passages.index, "Int64")
            yield passages[[*columns, "words", "grams"]]
            if near:
                yield pd.DataFrame(bound.aligned(near), columns=columns).assign(words=None, grams=None)

    return run


def _slices(lo: int, hi: int, around: int):
    """Parts of a passage; any alignment of ``around`` words lies within one.

    With a score above 0 it has fewer than two other words to each equal one,
    so it spans less than three times the item.
    """
    step = max(SLICE, 3 * around)
    while hi - lo > step + 3 * around:
        yield lo, lo + step + 3 * around
        lo += step
    yield lo, hi


def _align(shared):
    def run(batches):
        coded = shared.value[3]
        for b in batches:
            pairs = [(doc, int(p), at, words) for doc, at, words, items in zip(b["doc_id"], b["at"], b["words"], b["items"]) for p in items]
            pairs.sort(key=lambda f: (len(f[3]), f[0], f[2], f[1]))
            out = []
            for some in _batched(pairs):
                score, longest = _smith_waterman([f[3] for f in some], [coded[f[1]][1] for f in some])
                out += [(doc, coded[p][0], s, len(coded[p][1]), r, at) for (doc, p, at, _), s, r in zip(some, score, longest)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "item_words", "run", "at"])

    return run


def _smith_waterman(texts: list, items: list) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and longest equal run of each pair, all pairs at once."""
    width, height = max(map(len, texts)), max(map(len, items))
    a = np.full((len(texts), width), -1, np.int32)
    q = np.full((len(items), height), -2, np.int32)
    for k, (t, i) in enumerate(zip(texts, items)):
        a[k, : len(t)], q[k, : len(i)] = t, i
    ramp = GAP * np.arange(width + 1, dtype=np.int32)
    h = np.zeros((len(texts), width + 1), np.int32)
    runs = np.zeros((len(texts), width + 1), np.int32)
    best, longest = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    for j in range(height):
        same = a == q[:, j, None]
        step = np.zeros_like(h)
        step[:, 1:] = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] - GAP)
        np.maximum(step, 0, out=step)
        h = np.maximum.accumulate(step + ramp, axis=1) - ramp
        ahead = np.zeros_like(runs)
        ahead[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
        runs = ahead
        best, longest = np.maximum(best, h.max(1)), np.maximum(longest, runs.max(1))
    return best, longest

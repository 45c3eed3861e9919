"""Reading level of each document by a latent difficulty model.

Document levels t and word difficulties b lie on one scale: a word occurs most
in documents of its own level, log rate = a_w - (t_d - b_w)^2 / 2 up to what is
common to all words. As in a Rasch model the sum of the difficulties of a
document's words is sufficient for its level, and counts per level are
sufficient for a word, so both alternate cheaply: one pass over the documents
per round finds every level from the current words and counts each word by
level; the words are then fitted to those counts. Ratings pull the levels of
rated documents and so fix the scale's direction and its bands. The scale's
unit is free, so levels are kept at mean 0 and standard deviation 1.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join, stage
from .prose import _SIGNS, english_model, likeness, paragraphs, surely_english, triples, words_of

#: Words with a place of their own, most frequent first; the rest share BUCKETS places.
VOCABULARY, BUCKETS = 50_000, 4_096
#: Grid of levels, and its coarser steps by which words are counted.
GRID = np.linspace(-6.0, 6.0, 481)
STEPS = 48
#: Rounds at most, and the mean step of the words' difficulties (by occurrence) that ends them.
ROUNDS, SETTLED = 20, 0.04
#: Spread of levels before the words are seen, and of rated documents around their rating.
FREE, RATED = 1.0, 0.5
#: The bands from low to high, and their places on the scale.
BANDS = {"easy": -1.0, "middle": 0.0, "hard": 1.0}


@dataclass(frozen=True)
class Levels:
    """``documents``: (doc_id, n_words, level); ``borders`` between the bands."""

    documents: DataFrame
    borders: tuple[float, float]

    def banded(self) -> DataFrame:
        """(doc_id, n_words, level, band)."""
        low, high = self.borders
        band = F.when(F.col("level") < low, "easy").when(F.col("level") < high, "middle").otherwise("hard")
        return self.documents.withColumn("band", band)


def reading_levels(
    docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, rater: str, band: str, min_words: int = 40, vocabulary: int | None = VOCABULARY
) -> Levels:
    """Levels of all documents with at least ``min_words`` words of English prose.

    The ``vocabulary`` most frequent words have a difficulty of their own, all
    others share some by hash; with None every word has its own, and the driver
    and each task hold a few numbers and the text of each.

    Null, empty and short texts get no level; of repeated rows with one id the
    longest prose counts, once. Ratings count once per rater and band; null or
    unknown bands and null ids are ignored, as are ratings of documents without
    a level. Without any usable rating the scale's direction is arbitrary and
    the bands are thirds. Without documents the result is empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null")
    parts = stage(texts.mapInPandas(_paragraphs, "doc_id long, parts array<string>, at array<int>, n array<long>"), "parts")
    found = parts.where("at is null").select("doc_id", "parts")
    prose = stage(found.mapInPandas(_word_counts(min_words, _english(parts)), "doc_id long, n_words int, words array<string>, counts array<int>"), "prose")
    # one row per id: the ids that repeat are found from the small columns alone
    best = prose.groupBy(F.col("doc_id").alias("__id")).agg(F.max("n_words").alias("__n"), F.count("*").alias("__c"))
    repeated = cut(best.where("__c > 1"))
    if not repeated.isEmpty():
        hit = lookup_join(prose, repeated, "doc_id", "__id", "left")
        again = hit.where("__c is not null and n_words = __n").groupBy("doc_id", "n_words").agg(F.min(F.struct("words", "counts")).alias("w"))
        prose = stage(
            hit.where("__c is null").select("doc_id", "n_words", "words", "counts").unionByName(again.select("doc_id", "n_words", "w.words", "w.counts")), "prose"
        )
    value = F.element_at(F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv]), F.lower(F.trim(F.col(f"`{band}`"))))
    known = F.lower(F.trim(F.col(f"`{band}`"))).isin(*BANDS)
    ratings = (
        labels.where(F.col(f"`{label_id}`").isNotNull() & known)
        .select(F.col(f"`{label_id}`").cast("long").alias("__doc"), F.col(f"`{rater}`").alias("rater"), value.alias("value"))
        .distinct()
        .groupBy("__doc")
        .agg(F.median("value").alias("rated"))
    )
    words = prose.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.count("*").alias("df"), F.sum("w.counts").alias("n"))
    if vocabulary is not None:
        words = words.orderBy(F.desc("n"), "word").limit(vocabulary)
    top = words.toArrow().to_pandas().sort_values(["n", "word"], ascending=[False, True])
    places = spark.sparkContext.broadcast({w: k for k, w in enumerate(top["word"])})
    size = len(top) + (BUCKETS if vocabulary is not None else 0)
    coded = lookup_join(prose, cut(ratings), "doc_id", "__doc").select("doc_id", "n_words", "rated", "words", "counts")
    coded = stage(coded.mapInPandas(_code(places, len(top)), "doc_id long, n_words int, rated double, words array<int>, counts array<int>"), "coded")
    a, b = _start(coded, size)
    for _ in range(ROUNDS):
        a, b, step = _fit_words(coded, a, b, size)
        if step < SETTLED:
            break
    model = spark.sparkContext.broadcast((b, _log_norm(a, b)))
    documents = cut(coded.mapInPandas(_levels(model), "doc_id long, n_words int, rated double, level double"))
    mean, spread = documents.agg(F.avg("level"), F.stddev_pop("level")).first()
    documents = documents.withColumn("level", (F.col("level") - F.lit(mean or 0.0)) / F.lit(spread or 1.0))
    # levels lie on GRID and ratings between the bands, so all rated documents make few different pairs
    rated = documents.where("rated is not null").groupBy("level", "rated").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values(["level", "rated"])
    if len(rated):
        borders = _borders(*(rated[c].to_numpy(float) for c in ("level", "rated", "n")))
    else:
        got = documents.agg(F.percentile_approx("level", [1 / 3, 2 / 3], 10_000)).first()[0]
        borders = tuple(got) if got else (0.0, 0.0)
    return Levels(documents.drop("rated"), borders)


def _paragraphs(batches):
    """Each document's paragraphs that may be English, and at the end of a task
    the counts of all triples in those that surely are, at most 28^3."""
    counts = np.zeros(_SIGNS**3, np.int64)
    for batch in batches:
        docs, parts = [], []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            got = paragraphs(text)
            if got:
                docs.append(doc)
                parts.append(got)
        sure = filter(surely_english, itertools.chain.from_iterable(parts))
        while some := [triples(p) for p in itertools.islice(sure, 256)]:
            counts += np.bincount(np.concatenate(some), minlength=len(counts))
        yield pd.DataFrame({"doc_id": docs, "parts": parts, "at": None, "n": None})
    at = np.flatnonzero(counts)
    if len(at):
        yield pd.DataFrame({"doc_id": [None], "parts": [None], "at": [at.astype(np.int32)], "n": [counts[at]]})


def _english(parts: DataFrame):
    """The model of the English letters of all documents, for all tasks."""
    counted = parts.where("at is not null").select(F.explode(F.arrays_zip("at", "n")).alias("c"))
    got = counted.groupBy("c.at").agg(F.sum("c.n").alias("n")).toArrow().to_pandas()
    counts = np.zeros(_SIGNS**3)
    counts[got["at"]] = got["n"]
    return parts.sparkSession.sparkContext.broadcast(english_model(counts))


def _word_counts(min_words: int, english):
    def run(batches):
        for batch in batches:
            out = []
            for doc, parts in zip(batch["doc_id"], batch["parts"]):
                words = words_of(p for p in parts if likeness(p, english.value) > 0)
                if len(words) >= max(1, min_words):
                    names, counts = np.unique(np.array(words), return_counts=True)
                    out.append((doc, len(words), names.tolist(), counts.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "words", "counts"])

    return run


def _code(places, top: int):
    import zlib

    def run(batches):
        get = places.value
        for batch in batches:
            coded = [
                np.array([get[w] if w in get else top + zlib.crc32(w.encode()) % BUCKETS for w in words], np.int32) for words in batch["words"]
            ]
            yield batch.assign(words=coded)[["doc_id", "n_words", "rated", "words", "counts"]]

    return run


def _flat(batch: pd.DataFrame):
    """Word places, counts and the rows they belong to, of a batch."""
    sizes = batch["words"].map(len).to_numpy()
    words = np.concatenate([*batch["words"], np.zeros(0, np.int32)]).astype(np.int64)
    counts = np.concatenate([*batch["counts"], np.zeros(0, np.int32)]).astype(float)
    return words, counts, np.repeat(np.arange(len(batch)), sizes)


def _tally(found: DataFrame, size: int, steps: int) -> np.ndarray:
    """Sum sparse (place, step, n) rows; places and steps are bounded."""
    total = found.groupBy("place", "step").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros((size, steps))
    out[total["place"], total["step"]] = total["n"]
    return out


def _sparse(table: np.ndarray) -> pd.DataFrame:
    place, step = np.nonzero(table)
    return pd.DataFrame({"place": place.astype(np.int32), "step": step.astype(np.int32), "n": table[place, step]})


def _start(coded: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of all words, and difficulties from the rated documents alone."""

    def run(batches):
        out = np.zeros((size, 3))
        for batch in batches:
            words, counts, row = _flat(batch)
            rated = batch["rated"].to_numpy(float)[row]
            np.add.at(out[:, 0], words, counts)
            has = ~np.isnan(rated)
            np.add.at(out[:, 1], words[has], counts[has])
            np.add.at(out[:, 2], words[has], counts[has] * rated[has])
        yield _sparse(out)

    n, rated, value = _tally(coded.mapInPandas(run, "place int, step int, n double"), size, 3).T
    b = value / (rated + 5.0)
    if rated.sum():
        b = b - np.average(b, weights=n + 1e-12)
    else:  # no ratings: long-tail words start as the difficult ones
        b = -np.log((n + 1.0) / (n.sum() + 1.0))
        b = (b - np.average(b, weights=n + 1e-12)) / 3
    return np.log((n + 0.1) / max(1.0, n.sum())), b


def _log_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(GRID))
    for k, t in enumerate(GRID):
        z = a + b * t
        m = z.max()
        out[k] = m + np.log(np.exp(z - m).sum())
    return out


def _level_of(batch: pd.DataFrame, b: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Place on GRID of the most likely level of each document."""
    words, counts, row = _flat(batch)
    total = np.bincount(row, counts * b[words], minlength=len(batch))
    n = np.bincount(row, counts, minlength=len(batch))
    rated = batch["rated"].to_numpy(float)
    centre, spread = np.where(np.isnan(rated), 0.0, rated), np.where(np.isnan(rated), FREE, RATED)
    out = np.empty(len(batch), np.int64)
    for i in range(0, len(batch), 2048):
        s = slice(i, i + 2048)
        fit = total[s, None] * GRID - n[s, None] * norm - (GRID - centre[s, None]) ** 2 / (2 * spread[s, None] ** 2)
        out[s] = np.argmax(fit, axis=1)
    return out


def _levels(model):
    def run(batches):
        b, norm = model.value
        for batch in batches:
            blind = batch.assign(rated=np.nan)  # a document's own rating must not move its level
            yield batch[["doc_id", "n_words", "rated"]].assign(level=GRID[_level_of(blind, b, norm)] if len(batch) else [])

    return run


def _fit_words(coded: DataFrame, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One round: levels from words in one pass, then words from counts by level.
    The last value is the mean step of the difficulties, by occurrence."""
    model = coded.sparkSession.sparkContext.broadcast((b, _log_norm(a, b)))

    def run(batches):
        b, norm = model.value
        out = np.zeros((size, STEPS))
        for batch in batches:
            if len(batch):
                words, counts, row = _flat(batch)
                step = _level_of(batch, b, norm) * STEPS // len(GRID)
                np.add.at(out, (words, step[row]), counts)
        yield _sparse(out)

    table = _tally(coded.mapInPandas(run, "place int, step int, n double"), size, STEPS)
    middle = np.array([GRID[np.arange(len(GRID)) * STEPS // len(GRID) == s].mean() for s in range(STEPS)])
    weight = table.sum(0)
    if weight.sum():
        mean = np.average(middle, weights=weight)
        middle = (middle - mean) / max(1e-3, np.sqrt(np.average((middle - mean) ** 2, weights=weight)))
    n, before = table.sum(1), b
    first = table @ middle
    for _ in range(30):  # Newton on the Poisson likelihood of every word at once, with a prior on b
        rate = np.exp(np.clip(a[:, None] + b[:, None] * middle, -50, 20)) * weight
        r0, r1, r2 = rate.sum(1) + 1e-9, rate @ middle, rate @ middle**2
        g0, g1 = n + 0.1 - r0, first - r1 - b
        h2 = r2 + 1.0
        det = r0 * h2 - r1 * r1
        da, db = (g0 * h2 - g1 * r1) / det, (g1 * r0 - g0 * r1) / det
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -0.5, 0.5)
        if max(np.abs(da).max(), np.abs(db).max()) < 1e-3:
            break
    return a, b, float(np.average(np.abs(b - before), weights=n + 1e-12)) if len(n) else 0.0


def _borders(level: np.ndarray, rated: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Where a rating is as likely above a band's border as below, by a logistic
    curve, which single wrong ratings hardly move; ``n`` documents have each pair.
    A side without ratings puts the border beyond all levels."""
    cuts = []
    for at in (-0.5, 0.5):
        y = (rated > at).astype(float)
        if y.min() == y.max():
            cuts.append(GRID[0] - 1 if y.min() else GRID[-1] + 1)
            continue
        f = np.column_stack([np.ones(len(y)), level])
        w, ridge = np.zeros(2), np.diag([1e-6, 1e-3 * n.sum()])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            step = np.linalg.solve((f * (n * (p * (1 - p) + 1e-9))[:, None]).T @ f + ridge, f.T @ (n * (p - y)) + ridge @ w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        cut = -w[0] / w[1] if w[1] > 1e-6 else sum(np.average(level[y == k], weights=n[y == k]) for k in (0, 1)) / 2
        cuts.append(float(np.clip(cut, GRID[0] - 1, GRID[-1] + 1)))
    return min(cuts), max(cuts)

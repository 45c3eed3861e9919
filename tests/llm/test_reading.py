import random

import numpy as np
import pytest

from sheafline.llm import reading
from sheafline.llm.prose import english_model, likeness, messages, paragraphs, prose_words, triples
from sheafline.llm.reading import reading_levels

LOG = """commit 0123456789abcdef0123456789abcdef01234567
Merge: aaaaaaa bbbbbbb
Author: A B <a@b.test>
Date:   2020-01-01 00:00:00 +0000

    Subject line that does not count

    This is the first paragraph of the message and
    it goes on here.

    > quoted text is not ours
    | nor is this
    Someone Else wrote:

    Wir prüfen den Puffer vor dem Start und das ist nicht gut.

    - We have a bullet with `code_here()` in it.
    # Conflicts:
    #\tsrc/a.c

    Signed-off-by: A B <a@b.test>
    Fixes: 0123456789ab ("x")

 src/a.c | 3 ++-

diff --git a/src/a.c b/src/a.c
--- a/src/a.c
+++ b/src/a.c
@@ -1 +1 @@
-the old line of the code is here
+the new line of the code is here
"""
MAIL = """From 0123456789abcdef0123456789abcdef01234567 Mon Sep 17 00:00:00 2001
From: A B <a@b.test>
Date: Wed, 1 Jan 2020 00:00:00 +0000
Subject: [PATCH] fix the thing
 that is broken

The body of the mail is here.

Signed-off-by: A B <a@b.test>
---
 a.c | 2 +-

diff --git a/a.c b/a.c
+the code
-- 
2.30.0

"""
SVN = """------------------------------------------------------------------------
r123 | someone | 2020-01-01 00:00:00 +0000 | 3 lines

tests: pack it

The text of the old log is here.

Index: a.c
===================================================================
--- a.c\t(revision 1)
+the code
"""


def test_layouts():
    assert paragraphs(LOG) == ["This is the first paragraph of the message and it goes on here.", "- We have a bullet with `code_here()` in it."]
    assert paragraphs(MAIL) == ["The body of the mail is here."]
    assert paragraphs(SVN) == ["The text of the old log is here."]
    assert len(messages(LOG + MAIL + SVN + SVN)) == 4
    assert prose_words(LOG)[-6:] == ["have", "a", "bullet", "with", "in", "it"]


@pytest.mark.parametrize("text", [None, "", "\n\n", "commit", "no layout at all", "commit 0123456789\n", "-" * 72, "日本語のテキスト"])
def test_no_prose(text):
    assert prose_words(text) == []


EASY = "we see the cat and it is a big red one so i let it go now".split()
MIDDLE = "the report builder checks each record before the server restarts and then updates every saved filter".split()
HARD = "notwithstanding the epistemic instrumentation of heterogeneous subsystems the constitutive reconciliation precludes determination".split()


def document(rng, kind, n=60):
    words = [rng.choice({"easy": EASY, "middle": MIDDLE, "hard": HARD}[kind]) if rng.random() < 0.85 else rng.choice(EASY + MIDDLE + HARD) for _ in range(n)]
    return MAIL.replace("The body of the mail is here.", "the " + " ".join(words) + " of the")


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as words", "2 as level", "'b' as band").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, rater string, band string")


def test_bands_agree_on_held_out_documents(spark):
    rng = random.Random(0)
    truth = {i: rng.choice(["easy", "middle", "hard"]) for i in range(600)}
    docs = [(i, document(rng, k)) for i, k in truth.items()]
    docs += docs[:20] + [(700, None), (701, ""), (None, docs[0][1]), (702, "short")]
    labels = [(i, r, truth[i] if rng.random() < 0.9 else "middle") for i in range(60) for r in ("r1", "r2")]
    labels += labels[:10] + [(1, "r3", None), (2, "r3", "odd"), (None, "r1", "easy"), (9999, "r1", "hard")]
    d, lab = frames(spark, docs, labels)
    got = reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band").banded().collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    held = [r for r in got if r["doc_id"] >= 60]
    assert sum(truth[r["doc_id"]] == r["band"] for r in held) / len(held) > 0.95


def test_without_ratings_or_documents(spark):
    rng = random.Random(1)
    docs = [(i, document(rng, "easy" if i % 2 else "hard")) for i in range(40)]
    d, lab = frames(spark, docs, [])
    assert reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band").banded().count() == 40
    d, lab = frames(spark, [], [(1, "r", "easy")])
    assert reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band").banded().count() == 0


def test_very_long_text(spark):
    rng = random.Random(2)
    d, lab = frames(spark, [(1, document(rng, "easy", 200_000)), (2, document(rng, "hard", 60))], [(1, "r", "easy"), (2, "r", "hard")])
    got = {r["doc_id"]: r["n_words"] for r in reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band").banded().collect()}
    assert got == {1: 200_003, 2: 63}


# Sentences of languages without a list of words, in plain letters.
ELSEWHERE = {
    "it": "questa modifica corregge un errore nel caricamento dei file e rimuove il vecchio codice dalla cartella dei test prima del rilascio",
    "nl": "deze wijziging verhelpt een fout bij het laden van bestanden en de oude code is verwijderd uit deze map voordat wij verder gaan",
    "pl": "ta zmiana naprawia wczytywanie plikow z dysku oraz usuwa stary kod ktory nie byl juz nigdzie potrzebny w naszym projekcie",
    "pt": "esta alteracao corrige um erro ao carregar arquivos e remove o codigo antigo que ninguem mais usava neste modulo",
    "fi": "tama muutos korjaa virheen tiedostojen lataamisessa ja poistaa vanhan koodin jota kukaan ei enaa tarvitse",
    "de": "diese aenderung behebt fehler beim laden mehrerer dateien bevor alte pfade entfernt werden koennen",
}
PROSE = (
    "the report builder checks each record before the server restarts and then updates every saved filter "
    "we now read the settings once and keep them so that later calls do not have to open the same file again "
    "there was a small mistake in the way old entries were removed which left some of them behind after a crash"
)


def test_paragraphs_of_other_languages_are_no_english(spark):
    rng = random.Random(4)
    english = PROSE.split()
    docs = [(i, MAIL.replace("The body of the mail is here.", " ".join(english[rng.randrange(20) :] + english))) for i in range(60)]
    docs += [(100 + i, MAIL.replace("The body of the mail is here.", " ".join([t] * 4))) for i, t in enumerate(ELSEWHERE.values())]
    d, lab = frames(spark, docs, [(1, "r", "easy"), (2, "r", "hard")])
    got = {r["doc_id"] for r in reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band").documents.collect()}
    assert got == set(range(60))


def test_english_of_words_never_seen():
    counts = np.zeros(28**3)
    for w in (PROSE, np.percentile.__doc__, np.einsum.__doc__, np.linalg.svd.__doc__):
        counts += np.bincount(triples(w), minlength=28**3)
    model = english_model(counts)
    assert likeness("another thing is that the letters make the rest of these sentences rather clear", model) > 0
    assert all(likeness(t, model) < 0 for t in ELSEWHERE.values()) and likeness("", model) == likeness("42 7", model) <= 0
    assert not english_model(np.zeros(28**3)).any()


def test_every_word_with_a_place_of_its_own(spark):
    rng = random.Random(5)
    truth = {i: rng.choice(["easy", "middle", "hard"]) for i in range(300)}
    d, lab = frames(spark, [(i, document(rng, k)) for i, k in truth.items()], [(i, "r", truth[i]) for i in range(60)])
    bands = {}
    for vocabulary in (None, 50_000, 15):
        got = reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band", vocabulary=vocabulary).banded().collect()
        bands[vocabulary] = {r["doc_id"]: r["band"] for r in got}
        assert sum(truth[i] == b for i, b in bands[vocabulary].items()) / 300 > 0.9
    assert bands[None] == bands[50_000]


def test_letters_and_borders_come_from_all_documents(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, MAIL.replace("The body of the mail is here.", "the " + " ".join(rng.choices(EASY + MIDDLE, k=12)) + " of the")) for i in range(6000)]
    letters, rated = [], []
    model, borders = reading.english_model, reading._borders
    monkeypatch.setattr(reading, "english_model", lambda counts: letters.append(counts) or model(counts))
    monkeypatch.setattr(reading, "_borders", lambda *pairs: rated.append(pairs) or borders(*pairs))
    monkeypatch.setattr(reading, "RATED_ROWS", 100, raising=False)
    d, lab = frames(spark, docs, [(i, "r", "easy" if i % 2 else "hard") for i in range(6000)])
    reading_levels(d, "doc_id", "text", lab, "doc_id", "rater", "band", min_words=5)
    want = np.zeros(28**3)
    for _, text in docs:
        for p in paragraphs(text):
            want += np.bincount(triples(p), minlength=28**3)
    assert (letters[0] == want).all()
    assert sum(rated[0][-1]) == 6000


def test_borders_of_counted_pairs_are_those_of_single_documents():
    rng = np.random.default_rng(7)
    level = rng.integers(-4, 5, 500) / 2
    rated = np.clip(np.rint(level + rng.normal(0, 0.5, 500)), -1, 1)
    pairs, n = np.unique(np.column_stack([level, rated]), axis=0, return_counts=True)
    assert np.allclose(reading._borders(*pairs.T, n.astype(float)), reading._borders(level, rated, np.ones(500)))

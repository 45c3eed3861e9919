import os
import random

import pytest

from sheafline.llm import mixing
from sheafline.llm.mixing import PIECE, RANKS, _pieces, mix_sources

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer here")
T = "src_name string, target_share double, max_repeats int, src string, copies int"


def run(spark, docs, targets, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as src", "2 as copies", "3 as rate", "4 as n_tokens").repartition(3)
    t = spark.createDataFrame([(*x, "s", 0) for x in targets], T)
    return mix_sources(d, "doc_id", "text", "source", t, **how)


def test_shares_caps_and_names(spark):
    docs = [(i, "one two three four", ["Big", " big ", "BIG"][i % 3]) for i in range(3000)]
    docs += [(10_000 + i, "one two three four", ["Small-Set", "small set", "small_set"][i % 3]) for i in range(300)]
    docs += [(20_000, "x", None), (20_001, "x", "other"), (20_002, None, "big"), (None, "x", "big"), (20_003, "", "big")]
    m = run(spark, docs, [("big", 0.6, 1), ("small_set", 0.3, 3), ("absent", 0.1, 2)])
    s = {r["src_name"]: r for r in m.shares.collect()}
    assert s["small_set"]["rate"] == 3 and s["small_set"]["n_emitted"] == 900 == s["small_set"]["most_copies"] * 300
    assert s["big"]["real_share"] == pytest.approx(2 / 3, abs=0.02) and s["absent"]["real_share"] == 0
    rows = m.corpus.collect()
    assert len(rows) == sum(x["n_emitted"] for x in s.values()) and {r["src_name"] for r in rows} == {"big", "small_set"}
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    again = run(spark, docs, [("big", 0.6, 1), ("small_set", 0.3, 3), ("absent", 0.1, 2)]).corpus
    assert {(r["doc_id"], r["copy"]) for r in again.collect()} == {(r["doc_id"], r["copy"]) for r in rows}


def test_total_given_and_fractions(spark):
    docs = [(i, "alpha beta", "a" if i % 2 else "b") for i in range(4000)]
    per_doc = run(spark, docs[:1], [("b", 1.0, 1)]).shares.first()["n_tokens"]
    m = run(spark, docs, [("a", 0.5, 3), ("b", 0.5, 1)], total_tokens=6000 * per_doc)
    s = {r["src_name"]: r for r in m.shares.collect()}
    assert s["a"]["rate"] == pytest.approx(1.5) and s["b"]["rate"] == 1 and s["b"]["real_share"] < 0.5
    assert s["a"]["n_emitted"] == pytest.approx(3000, rel=0.05) and s["a"]["most_copies"] == 2


def test_empty_and_odd_targets(spark):
    docs = [(1, "x y", "a")]
    assert run(spark, [], [("a", 1.0, 1)]).corpus.count() == 0
    assert run(spark, docs, []).corpus.count() == 0
    for bad in ((("a"), None, 1), ("a", 1.0, None), ("a", -1.0, 2), ("a", 1.0, 0)):
        m = run(spark, docs, [bad])
        assert m.corpus.count() == 0 and m.shares.count() == 1
    two = run(spark, docs, [("a", 0.5, 3), ("A ", 0.5, 2), (None, 1.0, 1)]).shares.collect()
    assert [(r["target_share"], r["max_repeats"], r["n_emitted"]) for r in two] == [(1.0, 2, 2)]


def test_repeated_and_very_long_texts(spark):
    long = "word " * 300_000
    m = run(spark, [(1, long, "a"), (1, long, "a"), (2, "^" * 500_000, "a")], [("a", 1.0, 1)])
    assert m.corpus.count() == 3 and m.shares.first()["n_tokens"] > 600_000
    assert "".join(_pieces(long)) == long and max(map(len, _pieces(long))) <= 2 * PIECE


def test_every_source_misses_its_share_by_a_document_at_most(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.choice([1, 3, 10, 200]), rng.choice("aaaaabbbc")) for i in range(3000)]
    m = run(spark, docs, [("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, 4)])
    s = {r["src_name"]: r for r in m.shares.collect()}
    total = min(s[x]["n_tokens"] * c / w for x, w, c in (("a", 0.2, 2), ("b", 0.5, 3), ("c", 0.3, 4)))
    for x, w in (("a", 0.2), ("b", 0.5), ("c", 0.3)):
        assert abs(s[x]["tokens_emitted"] - w * total) <= 201
        assert abs(s[x]["deviation"]) <= 2 * 201 / total and s[x]["deviation"] == pytest.approx(s[x]["real_share"] - w)
    drawn = m.sized.where("src = 'a'").groupBy("copies").count().collect()
    assert len(drawn) == 2 and sum(r["count"] for r in drawn) == s["a"]["n_docs"]


def test_a_tiny_source_may_fall_short(spark):
    docs = [(i, "one two three", "big") for i in range(1000)] + [(5000, "one two three", "tiny")]
    few = {r["src_name"]: r for r in run(spark, docs, [("big", 0.97, 1), ("tiny", 0.03, 2)]).shares.collect()}
    assert few["big"]["n_emitted"] == pytest.approx(0.97 * 2 / 0.03, abs=1) and abs(few["tiny"]["deviation"]) < 0.01
    many = {r["src_name"]: r for r in run(spark, docs, [("big", 0.97, 1), ("tiny", 0.03, 2)], shortfall=0.02).shares.collect()}
    assert many["big"]["n_emitted"] == pytest.approx(0.98 * 2 / 0.01, abs=3) and many["tiny"]["deviation"] == pytest.approx(-0.02, abs=0.002)
    most = {r["src_name"]: r for r in run(spark, docs, [("big", 0.97, 1), ("tiny", 0.03, 2)], shortfall=0.05).shares.collect()}
    assert most["big"]["n_emitted"] == 1000 and most["tiny"]["n_emitted"] == 2


@pytest.mark.parametrize("text", ["a1" * 20, "don't stop=='s now" * 3, "abc" * 30, "===" * 30 + "'s x", "日本語" * 20 + "。", "x " * 40, " \n" * 50 + "y", "1234567" * 9])
def test_pieces_never_change_the_tokens(monkeypatch, text):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=mixing.PATTERN, mergeable_ranks=merges, special_tokens={})
    whole = len(encoding.encode_ordinary(text))
    for size in (1, 2, 5, 13):
        monkeypatch.setattr(mixing, "PIECE", size)
        pieces = list(_pieces(text))
        assert "".join(pieces) == text
        assert sum(len(encoding.encode_ordinary(p)) for p in pieces) == whole == sum(mixing._count_unbroken(encoding, p) for p in pieces)


def test_long_runs_are_counted_whole(spark):
    docs = [(1, "a" * 1_000_000, "a"), (2, "=" * 900_000 + "'s", "a"), (3, "4" * 700_000, "a")]
    m = run(spark, docs, [("a", 1.0, 1)])
    assert {r["doc_id"]: r["n_tokens"] for r in m.sized.collect()}[1] == 250_000

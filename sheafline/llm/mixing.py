"""Mixing sources to target weights with capped repetition."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stage

#: A public byte-level vocabulary as ranks; every executor has the file at this path.
#: Another one is named by ``ranks`` or the session's setting RANKS_SETTING.
RANKS, RANKS_SETTING = "/opt/tokenizers/byte_bpe_50k.tiktoken", "spark.sheafline.ranks"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources a target table may name; the rates are worked out on the driver.
MOST_TARGETS = 100_000
#: Texts are encoded in pieces of about so many characters, cut where tokens end anyway.
PIECE = 200_000
#: Bits of a document's hash; bits by which a source's threshold is narrowed down at a time.
HASH_BITS, STEP_BITS = 53, 12


@dataclass(frozen=True)
class Mix:
    """``sized``: (doc_id, src, n_tokens, copies) of documents of a target source;
    ``corpus``: one row per copy with its text; ``shares``: the report by source."""

    sized: DataFrame
    corpus: DataFrame
    shares: DataFrame


def folded(name: Column) -> Column:
    """Source names alike but for case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.trim(F.lower(name)), r"[\s_-]+", "_")


def mix_sources(
    docs: DataFrame,
    doc_id: str,
    text: str,
    source: str,
    targets: DataFrame,
    name: str = "src_name",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total_tokens: float | None = None,
    shortfall: float = 0.0,
    seed: int = 0,
    ranks: str | None = None,
) -> Mix:
    """Draw from every source its share of all tokens.

    Each document is emitted floor(rate) times, and once more if a hash of its
    id and ``seed`` lies below a threshold. For many documents the threshold is
    the rest of the rate, as for a draw with that probability; it is set so
    that the tokens drawn miss the rest by half a document at most. A document
    is never used more than the source's cap. Without ``total_tokens`` the
    total is the largest at which the sources that have documents miss, under
    their caps, together no more than ``shortfall`` of the whole; by default
    all reach their shares. Shares of sources without documents are spread over
    the others in proportion. With ``total_tokens`` sources that hit their cap
    fall short. The report has the shares reached and by how much each differs
    from the share wanted of the sources that have documents. Documents with a null id, null text, or a source that
    is null or no target are left out; empty texts have no tokens and take
    part. Targets that fold to one name add their shares under the smaller
    cap; null or negative shares and caps are 0. Repeated documents count as
    often as they come. Empty tables give an empty corpus.
    """
    named = targets.select(
        folded(F.col(f"`{name}`")).alias("src"),
        F.greatest(F.coalesce(F.col(f"`{share}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce(F.col(f"`{repeats}`").cast("int"), F.lit(0)), F.lit(0)).alias("cap"),
    ).where("src is not null")
    wanted = named.groupBy("src").agg(F.sum("share").alias("share"), F.min("cap").alias("cap")).limit(MOST_TARGETS + 1).toArrow().to_pandas()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame([(s,) for s in wanted["src"]], "__src string"))
    part = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), folded(F.col(f"`{source}`")).alias("src"), F.col(f"`{text}`").alias("text"))
        .where("doc_id is not null and text is not null")
        .join(known, F.col("src") == F.col("__src"))
        .drop("__src")
    )
    sized = stage(part.mapInPandas(_token_counts(ranks or spark.conf.get(RANKS_SETTING, RANKS)), "doc_id long, src string, n_tokens long"), "sized")
    have = sized.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).toArrow().to_pandas()
    plan = _rates(wanted.merge(have, on="src", how="left").fillna({"tokens": 0, "docs": 0}), total_tokens, shortfall)
    rates = F.broadcast(_thresholds(sized, plan, seed))
    sized = _with_copies(sized, rates, seed)
    corpus = _with_copies(part, rates, seed).where("copies > 0")
    corpus = corpus.select("doc_id", F.col("src").alias("src_name"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "text")
    used = sized.groupBy(F.col("src").alias("__s")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.sum("copies").alias("emitted"), F.max("copies").alias("most"))
    report = spark.createDataFrame(
        list(zip(plan["src"], map(float, plan["share"]), map(int, plan["cap"]), map(int, plan["docs"]), map(int, plan["tokens"]), map(float, plan["rate"]), map(float, plan["weight"]))),
        "src_name string, target_share double, max_repeats int, n_docs long, n_tokens long, rate double, __w double",
    )
    whole = used.agg(F.sum("got")).first()[0] or 0  # one row
    shares = report.join(used, F.col("src_name") == F.col("__s"), "left").select(
        *report.columns[:-1],
        F.coalesce("emitted", F.lit(0)).cast("long").alias("n_emitted"),
        F.coalesce("most", F.lit(0)).cast("int").alias("most_copies"),
        F.coalesce("got", F.lit(0)).cast("long").alias("tokens_emitted"),
        (F.coalesce("got", F.lit(0)) / F.lit(float(whole or 1))).alias("real_share"),
        (F.coalesce("got", F.lit(0)) / F.lit(float(whole or 1)) - F.col("__w")).alias("deviation"),
    )
    return Mix(sized, corpus, shares)


def _hash(seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << HASH_BITS))


def _with_copies(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    copies = (F.floor("rate") + (_hash(seed) < F.col("below")).cast("long")).cast("int")
    return rows.join(rates, F.col("src") == F.col("__src")).withColumn("copies", copies).drop("__src", "rate", "below")


def _thresholds(sized: DataFrame, plan: pd.DataFrame, seed: int) -> DataFrame:
    """(__src, rate, below) of every source: documents whose hash is under ``below`` come once more.

    The threshold is narrowed down by a few leading bits of the hash at a time:
    the tokens of each of their values are summed, and the value in which the
    wanted sum is reached is looked into next, until it holds one document. No
    document's size leaves its executor.
    """
    spark = sized.sparkSession
    rest = {s: (r - np.floor(r)) * t for s, r, t in zip(plan["src"], plan["rate"], plan["tokens"])}
    below = {s: 0 for s in rest}
    open_ = {s: (0, 0.0) for s, want in rest.items() if want > 0}  # leading bits, tokens under them
    hashed = sized.select("src", "n_tokens", _hash(seed).alias("__h"))
    bits = 0
    while open_:
        at, bits = HASH_BITS - bits, min(HASH_BITS, bits + STEP_BITS)
        state = spark.createDataFrame([(s, p, float(b), float(rest[s])) for s, (p, b) in open_.items()], "__s string, __p long, base double, want double")
        inside = hashed.join(F.broadcast(state), (F.col("src") == F.col("__s")) & (F.shiftright("__h", at) == F.col("__p")))
        sums = inside.groupBy("src", "base", "want", F.shiftright("__h", HASH_BITS - bits).alias("p")).agg(F.sum("n_tokens").alias("t"), F.count_distinct("__h").alias("n"))
        w = Window.partitionBy("src").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 2^STEP_BITS rows at most
        reached = sums.withColumn("upto", F.col("base") + F.sum("t").over(w)).where("upto >= want")
        first = reached.groupBy("src").agg(F.min(F.struct("p", "upto", "t", "n")).alias("r")).select("src", "r.*")
        found = {r["src"]: r for r in first.collect()}  # one row per source
        for s in list(open_):
            r = found.get(s)
            under = 0.0 if r is None else float(r["upto"] - r["t"])
            if r is None:  # rounding: all of the source's documents
                below[s] = 1 << HASH_BITS
            elif r["n"] > 1 and bits < HASH_BITS:
                open_[s] = (r["p"], under)
                continue
            else:
                below[s] = int(r["p"] + int(rest[s] - under > r["t"] / 2)) << (HASH_BITS - bits)
            del open_[s]
    return spark.createDataFrame([(s, float(r), below[s]) for s, r in zip(plan["src"], plan["rate"])], "__src string, rate double, below long")


def _rates(plan: pd.DataFrame, total: float | None, shortfall: float) -> pd.DataFrame:
    """Copies per document of every source, and the weights that its total aims at."""
    usable = (plan["share"] > 0) & (plan["tokens"] > 0) & (plan["cap"] > 0)
    weight = np.where(usable, plan["share"], 0.0)
    weight = weight / weight.sum() if weight.sum() > 0 else weight
    tokens = np.maximum(1, plan["tokens"].to_numpy(float))
    most = np.where(usable, plan["cap"] * tokens, 0.0)  # what a source can give
    if total is None:
        total = _largest_total(weight[usable], most[usable], shortfall)
    rate = np.minimum(weight * total / tokens, plan["cap"])
    near = np.round(rate)
    return plan.assign(weight=weight, rate=np.where(np.abs(rate - near) < 1e-9, near, rate))


def _largest_total(weight: np.ndarray, most: np.ndarray, shortfall: float) -> float:
    """The largest total of which the sources together miss ``shortfall`` at most."""
    if not len(weight):
        return 0.0
    order = np.argsort(most / weight, kind="stable")
    w, m = np.cumsum(weight[order]), np.cumsum(most[order])
    ends = (most / weight)[order]
    if shortfall <= 0:
        return float(ends[0])
    for k in range(len(ends)):  # with the first k + 1 sources at their caps the miss is w - m / total
        total = m[k] / (w[k] - shortfall) if w[k] > shortfall else np.inf
        if total <= (ends[k + 1] if k + 1 < len(ends) else np.inf):
            return float(min(total, m[-1] / max(1e-12, 1 - shortfall)))
    return float(ends[-1])


def _token_counts(ranks: str):
    def run(batches):
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

        def count(text):
            return sum(len(encoding.encode_ordinary(p)) if len(p) <= 2 * PIECE else _count_unbroken(encoding, p) for p in _pieces(text))

        for b in batches:
            yield b[["doc_id", "src"]].assign(n_tokens=np.array([count(t) for t in b["text"]], np.int64))

    return run


def _pieces(text: str):
    """Whole text in pieces of at most twice PIECE, if it has places where tokens end.

    Tokens end before a blank between two other signs, after the last letter of
    a word and after the last digit of a number, whatever follows. Only a run
    of one kind of signs gives a longer piece.
    """
    import regex

    ends = regex.compile(r"(?<=\S)\s(?=\S)|(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")
    while len(text) > 2 * PIECE:
        m = ends.search(text, PIECE)
        at = m.start() if m else len(text)
        if not at:
            break
        yield text[:at]
        text = text[at:]
    if text:
        yield text


def _count_unbroken(encoding, text: str) -> int:
    """Tokens of a text with a very long run, which the encoder's own splitting cannot take in one go."""
    import regex

    return sum(len(encoding._encode_single_piece(p.encode("utf-8", "replace"))) for p in regex.findall(PATTERN, text))

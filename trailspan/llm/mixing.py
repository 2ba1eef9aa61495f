"""Mixing to target weights with soft membership, in DataFrame operations alone.

A labelled table says which domain some documents belong to. A classifier learned from it predicts
for every document the probability of each domain. Each document then gets a nonnegative rate (how
often it is to be read) so that the expected tokens of each domain, the sum over documents of rate
x tokens x probability, match the targets as closely as nonnegative rates can, starting from rate
1 and moving no further than needed.

Classifier: a text is seen as its distinct words (runs between ASCII white space, in lower case), and
one mark more if most of its words are repeats. Of the words that are surely more or less frequent in
one domain of the labelled rows (``SURE`` standard deviations), the ``WORDS`` surest are known; the rest
count together as one. A text's score is the prior plus the log probability of each of its words.
It is learned on at most ``TRAIN_ROWS`` labelled rows, picked by a hash of their ids.

Rates: projected gradient descent on half the squared distance between expected and target tokens,
in the norm that the domains' own Gram matrix gives (which makes a unit step safe). A step needs
one sum for each domain over all documents, so the driver holds domains x domains numbers. A
document's rate follows from the steps' slopes and its own row, so nothing but those slopes is
kept between steps, and a lost executor costs no more than its tasks.

Defined cases: null or empty texts have no token, get the prior as posterior, and keep rate 1.
Null and unknown labels are left out; without any label all domains are equally likely for every
text. An empty table of documents gives an empty result. A document with several labels counts once for each. Rows with equal or null ids are
separate rows. Domains without a target have target 0. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

#: Fixed domains of the labels table: bits of (quality, toxic) and the targets that the query mixes to.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.08, "toxic": 0.02}
WORDS = 2_000
TRAIN_ROWS = 5_000
#: Standard deviations from which a word's difference between domains counts.
SURE = 4.0
#: Stands for a text of which most words are repeats; no word holds a space.
FEW = " few"
STEPS = 40
TOLERANCE = 1e-6


def words_of(text: Column) -> Column:
    """Lower-case words, as an array; empty for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def kinds_of(words: Column) -> Column:
    """The distinct words, and ``FEW`` behind them if at most half of the words are distinct."""
    kinds = F.array_distinct(words)
    return F.when((F.size(words) >= 8) & (2 * F.size(kinds) <= F.size(words)), F.concat(kinds, F.array(F.lit(FEW)))).otherwise(kinds)


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain that a row of the labels table names."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "clean")


def train(docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, words: int = WORDS, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[float], list[float]]:
    """(word, one weight for each domain), the domains' log priors and log probabilities of an unknown word,
    from labelled rows (doc_id, domain). A known word's weight is what it tells more than an unknown one."""
    sample = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(train_rows)
    sample = written(sample, "mix-sample")
    got = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    size = [float(got.get(d, 0)) for d in domains]
    prior = [float(np.log((n + 1.0) / (sum(size) + len(domains)))) for n in size]
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # train_rows narrow rows
    one = texts.select("domain", F.explode(kinds_of(words_of(F.col("text")))).alias("word"))
    counts = written(one.groupBy("word").agg(*(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains))), "mix-words")
    totals = counts.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(domains)))).first()
    total = [float(totals[k] or 0) + 1.0 for k in range(len(domains))]
    # How sure it is that a domain's texts have the word more or less often than all together, in standard deviations.
    every = reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in range(len(domains))]) / F.lit(max(1.0, sum(size)))
    sure = [F.abs(F.col(f"n{k}") / n - every) / F.sqrt(F.greatest(every * (1 - every), F.lit(1e-9)) / n) for k, n in enumerate(size) if n]
    best = counts.withColumn("told", F.greatest(*sure, F.lit(0.0), F.lit(0.0))).where(F.col("told") >= SURE).orderBy(F.desc("told"), "word").limit(words)
    share = [(F.col(f"n{k}") + 0.05) / F.lit(t) for k, t in enumerate(total)]
    best = written(best.select("word", *(s.alias(f"s{k}") for k, s in enumerate(share))), "mix-best")
    known = best.agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(domains)))).first()
    other = [float(np.log(max(1e-3, 1.0 - float(known[k] or 0.0)))) for k in range(len(domains))]
    return best.select("word", *((F.log(f"s{k}") - F.lit(o)).alias(f"w{k}") for k, o in enumerate(other))), prior, other


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float], other: list[float]) -> DataFrame:
    """doc_id, tokens, p (array, one probability for each domain), for every row of docs.

    Words are matched where they are, in the scan's own tasks: the model (at most ``WORDS`` rows) is
    broadcast, and only a row number, not the text, goes to the sum.
    """
    k = range(len(prior))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.size("words").cast("long").alias("tokens"), kinds_of(F.col("words")).alias("kinds"))
    # A row's words meet in its own task, so its sum is nearly done before the shuffle.
    hits = rows.select("row", "doc_id", "tokens", F.explode_outer("kinds").alias("word")).join(F.broadcast(model), "word", "left")
    sums = hits.groupBy("row", "doc_id", "tokens").agg(F.count("word").alias("kinds"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k))
    score = [F.col(f"s{i}") + F.lit(prior[i]) + F.col("kinds") * F.lit(other[i]) for i in k]
    top = F.greatest(*score) if len(prior) > 1 else score[0]
    part = [F.exp(s - top) for s in score]
    return sums.select("doc_id", "tokens", F.array(*(p / reduce(lambda a, b: a + b, part) for p in part)).alias("p"))


def _rate(tokens: Column, p: Column, slopes: list[list[float]], scale: float) -> Column:
    """The rate after these steps: each moves by the slope of its own row and stays at 0 or more."""
    if not slopes:
        return F.lit(1.0)
    history = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in slopes))
    own = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    moved = F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - own(g)))
    return F.when(tokens > 0, moved).otherwise(F.lit(1.0))


def fit_rates(members: DataFrame, targets: list[float], total: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[list[float]], list[dict]]:
    """Slopes of the steps taken, and what each step saw (expected tokens), for rows (tokens, p).

    Minimises 1/2 (A r - t)' G^-1 (A r - t) over r >= 0, where a row of A' is tokens x p and G = A W A'
    with W = 1 / tokens; in the rows' own scale (r times root of tokens) the unit step is safe because
    the scaled matrix has norm 1. ``total``: tokens that the mix is to have, those of the input if None.
    """
    k = range(len(targets))
    a = lambda i: F.col("tokens") * F.element_at("p", i + 1)
    gram = members.agg(F.sum("tokens").alias("n"), *(F.sum(a(i) * F.element_at("p", j + 1)).alias(f"g{i}_{j}") for i in k for j in k)).first()
    size = float(gram["n"] or 0)
    if size == 0:
        return [], []
    g = np.array([[gram[f"g{i}_{j}"] for j in k] for i in k], float)
    inverse = np.linalg.pinv(g + 1e-12 * np.trace(g) * np.eye(len(targets)))
    wanted = np.array(targets, float) / (sum(targets) or 1.0) * (size if total is None else total)
    slopes, seen, last = [], [], None
    for _ in range(steps):
        now = members.agg(*(F.sum(a(i) * _rate(F.col("tokens"), F.col("p"), slopes, size)).alias(f"e{i}") for i in k)).first()
        expected = np.array([now[f"e{i}"] for i in k], float)
        seen.append({"expected": expected.tolist(), "wanted": wanted.tolist()})
        near = tolerance * max(size, 1.0)
        if np.abs(expected - wanted).max() <= near or last is not None and np.abs(expected - last).max() <= 1e-3 * near:
            break  # at the targets, or as near as nonnegative rates come
        last = expected
        slopes.append((inverse @ (expected - wanted)).tolist())
    return slopes, seen


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, domains: tuple[str, ...] = DOMAINS, steps: int = STEPS) -> DataFrame:
    """doc_id, tokens, p_<domain> ..., rate: one row for each row of docs."""
    targets = TARGETS if targets is None else targets
    with scratch(docs.sparkSession, ("mix-members",)):
        model, prior, other = train(docs, labelled, domains)
        members = written(posteriors(docs, model, prior, other), "mix-members")
    slopes, _ = fit_rates(members, [float(targets.get(d, 0.0)) for d in domains], steps=steps)
    return members.select("doc_id", "tokens", *(F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(domains)), _rate(F.col("tokens"), F.col("p"), slopes, 1.0).alias("rate"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels table."""
    return labels.select(F.col("doc_id").cast("long"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target weights of the labels' domains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))

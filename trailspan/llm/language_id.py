"""Language identification by rank-order profiles of character n-grams.

A text's words (runs of letters, lower case, with a blank on either side) give n-grams of one to
``SIZES`` characters. A language's profile is the ``PROFILE`` most frequent n-grams of all its
training texts, in order. A document's own most frequent ``DOC_PROFILE`` n-grams are compared
with each profile: every n-gram costs the distance between its two ranks, or ``PROFILE`` where
the language doesn't have it. The language with the smallest sum wins.

Training counts words first: a task counts its distinct words by language and sends their sums,
so what Spark shuffles follows the vocabulary, not the text, and a common word is one row per
task. The profiles (``PROFILE`` rows for each language) go to the driver, languages being at most
``MOST_LANGUAGES``; more are refused, not cut.

Defined cases: a null text or one without a letter gives ``und`` and score 0. Training rows with
null text or null language count for nothing; without any training row every answer is ``und``.
Equal counts are ordered by the n-gram, equal distances by the language's name. A null document
id is scored like any other, repeated rows one by one. An empty table gives no row. Texts are used whole; other columns are kept,
but those named like the two new ones go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, slices, string_parts

#: n-grams have 1 to SIZES characters.
SIZES = 3
PROFILE = 600
DOC_PROFILE = 400
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Distinct words that a task counts before it sends them.
HELD_WORDS = 300_000
_BITS = 21  # of a Unicode code point

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes_of(text: str) -> np.ndarray:
    """Code points in lower case, 0 for each run of other characters, and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letter_table()[points], points, 0).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points = points[keep]
    out = np.zeros(len(points) + 2, np.int64)
    out[1:-1] = points
    if len(points) and points[0] == 0:
        out = out[1:]
    if len(points) > 1 and points[-1] == 0:
        out = out[:-1]
    return out


def grams(codes: np.ndarray, sizes: int = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as numbers, place of their first character). A blank stands only at an n-gram's ends."""
    found, places = [], []
    letter = codes != 0
    named = np.where(letter, codes, 1)  # 1 is no letter: " t" and "t" stay apart
    for n in range(1, min(sizes, len(codes)) + 1):
        at = np.arange(len(codes) - n + 1)
        value, any_letter, ok = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.ones(len(at), bool)
        for k in range(n):
            value = (value << _BITS) | named[k:k + len(at)]
            any_letter |= letter[k:k + len(at)]
            if 0 < k < n - 1:
                ok &= letter[k:k + len(at)]
        ok &= any_letter
        found.append(value[ok])
        places.append(at[ok])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


_COUNT_ARROW = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words between white space and how often they occur, by language."""
    held: dict[str, list[pa.Table]] = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, tables in held.items():
            whole = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            for b in whole.to_batches(max_chunksize=20_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * b.num_rows, pa.string()), b.column("word"), b.column("n_sum")], schema=_COUNT_ARROW)

    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang))
            for a, b in slices(string_parts(texts)[1], 2 << 20):
                words = pc.ascii_split_whitespace(pc.utf8_lower(texts.slice(a, b - a))).flatten()
                counted = pc.value_counts(words)
                held.setdefault(lang, []).append(pa.table({"word": counted.field("values").cast(pa.string()), "n": counted.field("counts").cast(pa.int64())}))
                size += len(counted)
        if size > HELD_WORDS:
            yield from sent()
            held, size = {}, 0
    if held:
        yield from sent()


_GRAM_ARROW = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _gram_counts(sizes: int):
    """n-grams of counted words; a task's equal n-grams are summed before they leave it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                mine = batch.filter(pc.equal(batch.column("lang"), lang))
                codes = codes_of(" ".join(mine.column("word").to_pylist()))
                if not codes.any():
                    continue
                # A row's words may hold several runs of letters: weights go by the row, through its characters.
                weights = _weights(mine.column("word"), mine.column("n").to_numpy(zero_copy_only=False), codes)
                gram, at = grams(codes, sizes)
                weight = np.maximum(weights[at], weights[np.minimum(at + 1, len(weights) - 1)] * (codes[at] == 0))
                old = total.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                gram, weight = np.append(old[0], gram), np.append(old[1], weight)
                order = np.argsort(gram, kind="stable")
                head = runs(gram[order])
                total[lang] = gram[order][head], np.add.reduceat(weight[order], head)
        for lang, (gram, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], schema=_GRAM_ARROW)

    return task


def _weights(words: pa.Array, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each code, how often the row it came from occurs; 0 for blanks."""
    joined = words.to_pylist()
    per_char = np.repeat(counts, [len(w.lower()) + 1 for w in joined])[:-1] if joined else np.empty(0, np.int64)
    points = np.frombuffer(" ".join(joined).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter_table()[points]
    out = np.zeros(len(codes), np.int64)
    out[codes != 0] = per_char[letters]
    return out


def train_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sizes: int = SIZES, profile: int = PROFILE) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, most frequent first, over all the rows of ``docs``."""
    if not 1 <= sizes <= 3:
        raise ValueError("n-grams of 1 to 3 characters fit a 64-bit number")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    words = rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = words.mapInArrow(_gram_counts(sizes), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Spark cuts each task to the limit before it shuffles: a language's rows that meet are few.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("place", place).where(F.col("place") <= profile)
    best = best.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))
    found = {r["lang"]: list(r["grams"]) for r in best.limit(MOST_LANGUAGES + 1).collect()}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    return found


class Ranks:
    """Profiles as one table: for each n-gram that any language has, its rank in each language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.known = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs])) if profiles else np.empty(0, np.int64)
        self.missing = max((len(p) for p in profiles.values()), default=1)
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def distance(self, ordered: np.ndarray) -> np.ndarray:
        """Sum of out-of-place distances to each language of n-grams in the order of their ranks."""
        at = np.searchsorted(self.known, ordered)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != ordered)] = len(self.known)
        theirs = self.rank[at]
        mine = np.arange(len(ordered))[:, None]
        return np.where(theirs < 0, self.missing, np.minimum(np.abs(theirs - mine), self.missing)).sum(axis=0)


def ranked(text: str, sizes: int = SIZES, most: int = DOC_PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first; ties by the smaller n-gram."""
    gram = grams(codes_of(text), sizes)[0]
    if not len(gram):
        return gram
    gram.sort()
    head = runs(gram)
    n = np.diff(np.append(head, len(gram)))
    return gram[head][np.argsort(-n, kind="stable")[:most]]


def predict(text: str | None, ranks: Ranks, sizes: int = SIZES, most: int = DOC_PROFILE) -> tuple[str, float]:
    """(language, score): 0 where the text is as far from it as can be, 1 where the ranks agree."""
    mine = ranked(text, sizes, most) if text else np.empty(0, np.int64)
    if not len(mine) or not ranks.langs:
        return UNKNOWN, 0.0
    d = ranks.distance(mine)
    best = int(np.argmin(d))
    return ranks.langs[best], float(1.0 - d[best] / (len(mine) * ranks.missing))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", sizes: int = SIZES, most: int = DOC_PROFILE, pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """docs with two columns behind its own: the language and its score (old columns of these names go)."""
    ranks = Ranks(profiles)
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower())]

    @F.pandas_udf("lang string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, ranks, sizes, most) for t in texts], columns=["lang", "score"])

    found = docs.select(F.struct(*own).alias("own"), guess(F.col(f"`{text_col}`").cast("string")).alias("guess"))
    return found.select("own.*", F.col("guess.lang").alias(pred_col), F.col("guess.score").alias(score_col))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from training: by the check sum of its id as text; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train_profiles(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"))

"""The pipeline: every stage on the rows its predecessor kept, against plain versions; and its edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailspan.llm import token_store

from .test_operators import plain_components, plain_matches

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with copies, benchmark passages, texts without a letter, nulls and repeated rows."""
    rng = random.Random(9)
    base = str(tmp_path_factory.mktemp("tables"))
    langs = {"en": "the of and to in is was for that with on are as at by from".split(), "de": "der die das und ist nicht ein eine zu von mit den für auf dem sich".split()}
    prose = lambda lang, n: " ".join(rng.choice(langs[lang]) + rng.choice(["", "", "x", "ung" if lang == "de" else "ing", "q%d" % rng.randrange(90)]) for _ in range(n))
    items = [(k, prose("en", 20)) for k in range(4)]
    rows = [(k, prose("en" if k % 3 else "de", rng.randint(30, 90))) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(110 + k, rows[k][1] + " end") for k in range(5)]
    rows += [(120 + k, f"{prose('de', 30)} {items[k][1]} {prose('de', 10)}") for k in range(4)]
    rows += [(130, None), (131, ""), (132, "12 34 !"), (None, prose("en", 40)), (133, prose("en", 20_000)), (134, prose("de", 40)), (134, prose("de", 40)), (135, "Idiot " + prose("en", 40))]
    docs = [(d, t, None if d is None else "de" if d % 3 == 0 and d < 100 else "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, COLUMNS).withColumn("words", F.lit("w")).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    labels = [(k, int(k % 5 != 0), int(k % 11 == 0)) for k in range(60)] + [(None, 1, 0), (61, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages_against_plain_versions(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        if name != "token_ids":
            assert docs.columns == columns
        seen[name] = before, docs.collect()
    before, after = seen["language_id"]
    assert Counter((r.doc_id, r.text) for r in after) == Counter(x for x in before if re.search(r"[^\W\d_]", x[1] or ""))
    before, after = seen["ngram_jaccard"]
    named = plain_components(before)
    assert Counter(r.doc_id for r in after) == Counter(d for d, n, c in named if n == 0 or d is None or d == c)
    assert len(after) < len(before)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {d for d, _ in plain_matches(before, items)}
    assert {120, 121, 122, 123} <= hit
    assert Counter((r.doc_id, r.text) for r in after) == Counter(x for x in before if x[0] not in hit)
    before, after = seen["mixing"]
    assert {(r.doc_id, r.text) for r in after} <= set(before) and after
    before, after = seen["token_ids"]
    plain = token_store.Encoder(token_store.tokenizer_file(token_store.VOCABULARY)).tokenizer
    start = 0
    want = []
    for d, t in sorted(before, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in after), key=lambda r: r[1]) == want


def test_mixing_takes_effect_and_is_fixed(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, two = ([(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()] for _ in range(2))
    assert Counter(one) == Counter(two)
    from trailspan.llm import mixing

    rates = {r.doc_id: r.rate for r in mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    times = Counter(d for d, _ in one)
    for d, rate in rates.items():
        if d is not None and d != 134:
            assert times[d] in (int(rate), int(rate) + 1)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    base = str(tmp_path)
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{base}/{name}.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.mode("overwrite").parquet(f"{base}/documents.parquet")
    assert corpus_pipeline.run(spark, base).count() > 0


def test_near_duplicates_are_those_of_five_words_and_eighty_percent(spark):
    rng = random.Random(2)
    rows = []
    for k, edits in enumerate([11, 11, 8, 12, 15, 30]):
        w = [f"n{k}x{j}" for j in range(500)]
        other = list(w)
        for place in range(edits):  # scattered: no two edits in one shingle
            other[20 + place * 15] = f"e{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    rows += [(None, rows[0][1]), (40, None), (41, "a b c d"), (42, "A b c d"), (43, "a b c")]
    sets = {d: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} for d, t in rows if d is not None and (w := (t or "").lower().split())}
    gone = {y for y in sets for x in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert Counter(kept) == Counter(d for d, _ in rows if d not in gone) and {1, 3, 5, 42} <= gone and not {7, 9, 11} & gone

"""Operators 11 to 13 and the links of operator 4 against plain versions, on small tables with awkward rows."""

import hashlib
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailspan.llm import html_text, kd_search, ngram_join, phrases, token_alignment, token_store
from trailspan.llm.common import Words, string_parts, tokenizer_file

from .test_operators import plain_sets, table


def plain_phrases(rows, at_least, top):
    """lang, rank, phrase, a, l, r, n, score by counting everything."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                count[lang].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if a >= at_least and " " in p}
        found = []
        for p, a in often.items():
            words = p.split(" ")
            if any(b >= a and f" {p} " in f" {q} " and q != p for q, b in often.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(4)
    words = ["a", "b", "A", "c", "de", "é", "日本", "x-y", "\x00"]
    ends = [".", ", ", "\n", " ; ", "\x0b", "\r\n", "  ", "\t", ""]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", rng.choice(ends)]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, ""]), text))
    rows += [("en", "new york city hall"), ("en", "new york city hall")] * 8 + [("fr", None), (None, ""), ("de", " \t. "), ("en", "a " * 4000), ("one", "z")]
    return rows


@pytest.mark.parametrize("at_least,options", [(8, {}), (3, {"bits": 8, "block": 40, "announced_by": 1}), (1, {"bits": 23, "block": 2000, "announced_by": 2})])
def test_collocations(spark, talk, at_least, options):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in talk], "lang string, text string, n long, phrase string, id long").repartition(6)
    got = phrases.collocations(docs, at_least, top=25, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(talk, at_least, 25)


def test_phrases_of_one_task_are_announced_at_last(spark):
    """A phrase that only one task has may not be that task's to announce at first."""
    rows = [("en", "rare pair " * 5)] + [("en", f"x{k} y{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartitionByRange(8, "text")
    for bits in (3, 20):
        got = phrases.collocations(docs, 4, bits=bits, announced_by=1)
        assert [tuple(r) for r in got.collect()] == plain_phrases(rows, 4, 2000) != []


def test_full_buckets_are_never_explained():
    b = phrases.Buckets(4)
    for _ in range(3):
        b.add(np.repeat(np.uint64([0, 1 << 60, 15 << 60]), [300, 1, 40_000]))
    (at, n), = b.full()
    assert at.tolist() == [0, 1, 15] and n.tolist() == [900, 3, phrases.Buckets.MANY]


def test_collocations_of_nothing_and_large_numbers(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, ".")], "lang string, text string"), 1).count() == 0
    big = 2_500_000_000_000_000
    row = spark.createDataFrame([(big, big)], "f long, n long").select(F.expr("cast(1000 * cast(f as decimal(19,0)) * n as decimal(38,0)) div cast(cast(f as decimal(19,0)) * f as decimal(38,0))").alias("s"))
    assert row.first().s == 1000


def test_double_array_holds_exactly_its_phrases():
    rng = np.random.default_rng(2)
    for n, kinds, size in ((0, 5, 2), (1, 1, 2), (400, 8, 3), (3000, 700, 2), (3000, 40, 5)):
        keys = np.unique(rng.integers(0, kinds, (n, size + 1)), axis=0)
        names = np.array([f"w{k}" for k in range(kinds)])
        hashed = Words(*string_parts(pa.array(names.tolist() or [""]))).hashes()
        langs = [f"l{k % 3}" for k in keys[:, 0].tolist()]
        order = rng.permutation(len(keys))
        keep = {(langs[i], *keys[i, 1:].tolist()): int(i) for i in order}
        chosen = sorted(keep.values())
        trie = phrases.DoubleArray([langs[i] for i in chosen], hashed[keys[chosen, 1:]].reshape(-1, size), np.array(chosen, np.int64))
        stream = rng.integers(0, kinds, 500)
        for lang in ("l0", "l1", "l9"):
            pieces = phrases.Pieces(*string_parts(pa.array([" ".join(names[stream])])))
            at, state = trie.states(pa.array([lang]), pieces)
            got = dict(zip(at.tolist(), trie.ids[state].tolist(), strict=True))
            want = {i: keep[(lang, *stream[i:i + size].tolist())] for i in range(500 - size + 1) if (lang, *stream[i:i + size].tolist()) in keep}
            assert got == want


def plain_alignment(texts):
    """Digest, numbers and links of each text, by walking both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_file(token_alignment.BYTE_LEVEL))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(token_alignment.PIECES))
    names = {k: t for t, k in one.get_vocab().items()}
    spec = json.load(open(tokenizer_file(token_alignment.BYTE_LEVEL)))
    assert spec["pre_tokenizer"]["type"] == "ByteLevel"
    signs, n = {}, 0
    for b in range(256):
        plain = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        signs[chr(b) if plain else chr(256 + n)] = b
        n += not plain
    out = []
    for t in texts:
        raw = b" " + (t or "").encode()
        a = [(k, bytes(signs[c] for c in names[k])) for k in one.encode(f" {t}", add_special_tokens=False).ids] if t else []
        b = [(k, bytes([int(two.id_to_piece(k)[3:5], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()) for k in two.encode(t)] if t else []
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append((0, 0, 0, 0, "", Counter()))
            continue
        groups, i, j, ga, gb, la, lb = [], 0, 0, [], [], 0, 0
        while i < len(a) or j < len(b):
            if la <= lb and i < len(a):
                la += len(a[i][1])
                ga.append(a[i][0])
                i += 1
            else:
                lb += len(b[j][1])
                gb.append(b[j][0])
                j += 1
            if la == lb:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), links))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_alignment(spark, awkward_texts, block_bytes, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK_PAIRS", 50)
    rows = awkward_texts
    plain = plain_alignment([t for _, t in rows])
    holders = Counter(p for x in plain for p in x[5])
    best = Counter()
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    want = []
    for (d, _), (n_a, n_b, n_groups, n_links, sha, links) in zip(rows, plain, strict=True):
        want.append((d, n_a, n_b, n_groups, n_links, sum(n for p, n in links.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in links.items()), sha))
    got = token_alignment.alignment_digests(table(spark, rows).repartition(3), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    blocks, counts = token_alignment.aligned(table(spark, rows), block_bytes=block_bytes)
    size = token_alignment.Side(tokenizer_file(token_alignment.PIECES)).size
    assert {(r.a, r.b): r.documents for r in counts.collect()} == holders and all(r.pair == r.a * size + r.b for r in counts.collect())


def test_alignment_holds_one_block_at_a_time(spark, awkward_texts, monkeypatch):
    """Lists of all pairs of a task's blocks stood in its heap, and a batch was 10,000 rows, of texts or of blocks."""
    name, seen, real = "spark.sql.execution.arrow.maxBytesPerBatch", [], token_alignment.written

    def noted(df, what):
        seen.append(spark.conf.get(name))
        return real(df, what)

    monkeypatch.setattr(token_alignment, "written", noted)
    before = spark.conf.get(name, None)
    out = token_alignment.alignment_digests(table(spark, awkward_texts).repartition(3), block_bytes=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert seen == [str(token_alignment.BATCH_BYTES)] and spark.conf.get(name, None) == before
    assert out.count() == len(awkward_texts)


def test_parts_of_a_block_are_aligned_as_the_whole(awkward_texts, monkeypatch):
    one, two = (token_alignment.Side(tokenizer_file(p)) for p in (token_alignment.BYTE_LEVEL, token_alignment.PIECES))
    texts, sizes, real = pa.array([t for _, t in awkward_texts], pa.string()), [], token_alignment.align
    want = real(texts, one, two)
    monkeypatch.setattr(token_alignment, "ALIGNED_BYTES", 200)
    monkeypatch.setattr(token_alignment, "align", lambda t, *sides: sizes.append(len(t)) or real(t, *sides))
    got = token_alignment.align_parts(texts, one, two)
    assert len(sizes) > 5 and sum(sizes) == len(texts) and got.keys() == want.keys()
    assert all(list(got[c]) == list(want[c]) for c in want)


@pytest.fixture(scope="module")
def awkward_texts():
    rng = random.Random(8)
    words = ["the", "Über", "naïve", "日本語", "x,y", "<s>", "<|endoftext|>", "\n\n", "   ", "é́", "🙂👩‍🚀", "</s>", "zz▁z", "\x00", "1234567", "antidisestablishment"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 40)))) for k in range(40)]
    rows = [(d, t.replace("▁", "") if d % 2 else t) for d, t in rows]
    rows += [(100, None), (101, ""), (102, " "), (None, "no id here"), (None, None), (7, "again"), (7, "again"), (103, "á" * 3000), (104, "".join(chr(0x4E00 + 37 * k) for k in range(900))), (105, "word " * 5000), (106, "\t  ")]
    return rows


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.alignment_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def plain_top(rows, k):
    """(query_id, rank, vec_id, score) for every hundredth id."""
    good = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(x)) for i, x in good if i % 100 == 0}:
        v = np.array(v)
        found = sorted((-int((v[:min(len(v), len(w))] * w[:min(len(v), len(w))]).sum()), i) for i, w in good if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(0, 1, 8).round(2).tolist()) for i in rng.permutation(900)]
    same = rng.normal(0, 1, 8).round(2).tolist()
    rows += [(1000 + i, same) for i in range(400)]  # a third of all rows
    rows += [(2000, None), (2001, []), (2100, [1.0, None]), (2002, [float("nan")] * 8), (2200, [float("inf"), 1.0]), (None, same), (2300, [5.0, -5.0]), (2003, [0.0] * 12)]
    rows += [(300, same), (5, same), (1000, same), (-100, [-1.0] * 8), (2400, [0.0] * 8)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 50, "leaf": 4, "section": 2, "group": 3}, {"shard_rows": 7, "leaf": 1, "section": 40, "group": 100}])
def test_top_k(spark, vectors, sizes):
    rows = spark.createDataFrame([(i, v, 1, "s") for i, v in vectors], "vec_id long, embedding array<double>, shard int, query string").repartition(3)
    got = kd_search.top_k(rows, F.col("vec_id") % 100 == 0, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top(vectors, 10)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert kd_search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert kd_search.top_k(spark.createDataFrame([(1, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    assert kd_search.top_k(spark.createDataFrame([(100, [1.0])], schema), F.col("vec_id") % 100 == 0).count() == 0
    few = kd_search.top_k(spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [2.0])], schema), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in few.collect()) == [(100, 1, 1, 2 << 20), (100, 2, 2, 2 << 20)]
    with pytest.raises(Exception, match="exact scores|64 bits"):
        kd_search.top_k(spark.createDataFrame([(100, [1e30]), (1, [1e30])], schema), F.col("vec_id") % 100 == 0).count()


def test_tree_skips_boxes():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (40, 16))
    vectors = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-20, 20, (20_000, 16))).astype(np.int64)
    tree = kd_search.Tree.built(np.arange(20_000), vectors)
    best = kd_search.Best(np.arange(0, 20_000, 200), np.full(100, kd_search._NONE), 10)
    compared = kd_search.search(tree, vectors[::200], best)
    scores = vectors[::200] @ vectors.T
    scores[np.arange(100), np.arange(0, 20_000, 200)] = -(1 << 60)
    assert (best.score == -np.sort(-scores, axis=1)[:, :10]).all()
    assert compared < 0.25 * 100 * 20_000  # bounds skip most rows


def plain_links(rows):
    sets = plain_sets(rows)
    return sorted(((d, sum(1 for j, (_, b) in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b))) for i, (d, a) in enumerate(sets)), key=str)


def drifting(n, words=120, seed=5):
    """Near copies that change step by step, so that a group reaches far beyond its first text; some copies are exact."""
    rng = random.Random(seed)
    names = [f"v{k}" for k in range(500)]
    text, rows = [rng.choice(names) for _ in range(words)], []
    for k in range(n):
        if k % 7:
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(words)] = rng.choice(names)
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize("cell,parts", [(512, 1), (16, 200)])
def test_links_are_all_counted(spark, cell, parts, monkeypatch):
    monkeypatch.setattr(ngram_join.count_links, "__defaults__", (ngram_join.PERCENT, cell))
    rows = drifting(200) + [(500, None), (501, ""), (502, "a b"), (503, "A B"), (None, "a b"), (504, "q w e r t y")]
    got = ngram_join.similar_documents(table(spark, rows).repartition(parts), block=32)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == plain_links(rows)


def test_a_large_group_outside_its_hub_gives_few_links():
    n, label = 300, np.arange(300)
    link = ~np.eye(n, dtype=bool)
    i, j = ngram_join.spanning(link, label)
    assert len(i) == n - 1 and len(set(i.tolist()) | set(j.tolist())) == n
    link = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        link[a, b] = link[b, a] = True
    i, j = ngram_join.spanning(link, np.array([9, 8, 9, 7, 7, 6]))
    assert len(i) == 2 and all(link[a, b] for a, b in zip(i, j, strict=True))


@pytest.mark.parametrize("percent", [60, 79, 80, 85, 95])
def test_sets_that_link_share_an_index_entry(percent):
    """Shingles of one set alone are spread so that they cut the shared ones as often as they can."""
    rng, run, tried = random.Random(percent), ngram_join.run_length(percent), 0
    assert run == 1 + (percent >= 79)
    for k in range(4000):
        size = 1 + k % 200
        alone = min(size, size * (100 - percent) // 100 + rng.randint(0, 1))
        step = rng.choice([1, 2, 2, 2, 3])
        at = [step * i for i in range(alone)] if rng.random() < 0.7 else rng.sample(range(size), alone)
        share, kind = rng.choice([0, 0.2, 0.5, 0.8, 1]), ["b"] * max(size, *(a + 1 for a in at), 1) if at else ["b"] * size
        for a in at:
            kind[a] = "x" if rng.random() < share else "y"
        x, y = ([i for i, c in enumerate(kind) if c != other] for other in "yx")
        both = kind.count("b")
        if x == y or 100 * both < percent * len(kind):
            continue
        tried += 1
        count = ngram_join.entries(np.array([len(x), len(y)]), percent, run)
        assert count[0] + run - 1 <= len(x) and count[1] + run - 1 <= len(y)
        one, two = ({tuple(v[i:i + run]): i for i in range(n)} for v, n in zip((x, y), count.tolist(), strict=True))
        i, j = min((one[e], two[e]) for e in one.keys() & two.keys())
        assert ngram_join.most_shared(i, j, len(x) - i, len(y) - j, run) >= both
        for block in (1, 32):
            p, q = ngram_join.list_pairs(np.array([len(x), len(y)]), np.array([i, j]), percent, block, run)
            assert {p.tolist()[0], q.tolist()[0]} == {0, 1}
    assert tried > 300


def test_shingles_shared_by_chance_make_few_pairs(spark, monkeypatch):
    """Texts of few words share single shingles with ever more others as a table grows: each pair was sent on with its sketches."""
    rng, seen = random.Random(3), {}
    names = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(names[:rng.choice([3, 8, 40])]) for _ in range(100))) for k in range(300)]
    rows += [(300 + k, f"{rows[k][1]} end") for k in range(20)]
    real = ngram_join.written

    def counted(df, name):
        out = real(df, name)
        seen[name] = out.select("x", "y").distinct().count() if name == "join-pairs" else 0
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    got = ngram_join.similar_documents(table(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == plain_links(rows)
    assert 20 <= seen["join-pairs"] < 100


def test_a_long_index_list_meets_by_its_hub():
    """Near copies of which no task saw two: one star for each, no pairs."""
    for n in (40, 63, 64, 1000):
        fp = np.arange(n, dtype=np.int64) * 7 + 3
        rows = [{"bucket": 0, "star": False, "a": fp[k:k + 1].tobytes(), "b": np.uint32([5]).tobytes(), "n": np.int32([100]).tobytes(), "pos": np.int32([0]).tobytes()} for k in range(n)]
        got = ngram_join._listed(85)(pa.Table.from_pylist(rows, ngram_join._PACKED_ARROW))
        if n < ngram_join.HUB_LIST:
            assert len(got) == n * (n - 1) // 2 and not any(got.column("star").to_pylist())
        else:
            assert sorted(got.column("x").to_pylist()) == fp[1:].tolist() and set(got.column("y").to_pylist()) == {3} and all(got.column("star").to_pylist())


def test_tokenizer_with_other_rules_encodes_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    encoder = token_store.Encoder(path)
    assert not encoder.by_words and token_store.Encoder(tokenizer_file(token_store.VOCABULARY)).by_words
    texts = ["A  b\n", None, "", "<|endoftext|>x"]
    ids, n = encoder(pa.array(texts), 7)
    plain = Tokenizer.from_file(path)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


FLAT = (
    "<body>" + "".join(f"<div><a href=x>{w}</a></div>" for w in "Home News Sport About".split()) + "<div>Buy now</div><div>" + "word " * 60 + "</div><div>" + "text " * 70
    + "</div><div>a short line</div><div>" + "more " * 50 + "</div><div>Sale 50%</div><div><a href=y>Imprint</a></div></body>"
)


def test_clusters_decide_the_lines_of_flat_pages(monkeypatch):
    want = "\n\n".join([("word " * 60).strip(), ("text " * 70).strip(), "a short line", ("more " * 50).strip()])
    assert html_text.main_text(FLAT) == want
    monkeypatch.setattr(html_text, "clusters", lambda values, threshold: np.ones(len(values), bool))
    assert "Buy now" in html_text.main_text(FLAT) and "Sale 50%" in html_text.main_text(FLAT)


def labelled_pages():
    """(page, the words of its article) in several layouts; article words start with w, all others don't."""
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    noise = lambda n: " ".join(f"n{rng.randrange(99)}" for _ in range(n))
    for k in range(80):
        paragraphs = [prose(rng.choice([1, 4, 20, 40, 90])) for _ in range(rng.randint(3, 12))] + [prose(60)]
        tag = "div" if k % 4 == 3 else "p"
        body = "".join(f"<{tag}>{t}</{tag}>" for t in paragraphs)
        menu = "".join(f"<li><a href=/{i}>{noise(1)}</a></li>" for i in range(8))
        wrap = [f"<article>{body}</article>", f'<div id="content">{body}</div>', f"<main><div>{body}</div></main>", body][k % 4]
        yield f"<body><ul>{menu}</ul><div>{noise(2)}</div>{wrap}<div>{noise(2)}</div><div><a href=x>{noise(3)}</a></div><footer>{noise(9)}</footer></body>", " ".join(paragraphs).split()


def test_word_precision_and_recall_of_main_texts():
    hit = found = wanted = 0
    for page, words in labelled_pages():
        got = html_text.main_text(page).split()
        hit, found, wanted = hit + sum((Counter(got) & Counter(words)).values()), found + len(got), wanted + len(words)
    assert hit / found >= 0.99 and hit / wanted >= 0.99, (hit / found, hit / wanted)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000 + "x", "<p>" + "<b>x</i><div></div>" * 50_000, "<b><i>" * 50_000 + "<div>a</div>" * 50_000, "<li><b>" * 50_000])
def test_unclosed_tags_cost_no_square(page):
    start = time.process_time()
    assert isinstance(html_text.main_text(page), str)
    assert time.process_time() - start < 8


def test_encoder_forgets_without_changing_ids():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé.,'1İ") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(40)]
    path = tokenizer_file(token_store.VOCABULARY)
    small, large = token_store.Encoder(path, remembered=20), token_store.Encoder(path)
    for t in texts:
        (a, n), (b, m) = small(pa.array([t]), 1), large(pa.array([t]), 1)
        assert a.tolist() == b.tolist() == [*small.tokenizer.encode(t, add_special_tokens=False).ids, 1] and n.tolist() == m.tolist()


def test_phrases_reach_python_in_small_batches(spark):
    """A task's rows were one batch of 10,000, held by the JVM and by the worker as well."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name, None)
    real = phrases.frequent_phrases

    def watched(docs, *args, **options):
        text = docs.select(F.col("text")).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long")
        seen.extend(r.n for r in text.collect())
        return real(docs, *args, **options)

    docs = spark.range(0, 6000, 1, 1).select(F.lit("en").alias("lang"), F.expr("repeat(concat('a b', id % 7, ' '), 400)").alias("text"))
    try:
        phrases.frequent_phrases = watched
        got = phrases.collocations(docs, 5).count()
    finally:
        phrases.frequent_phrases = real
    assert got and len(seen) > 4 and max(seen) < 2 * phrases.BATCH_BYTES
    assert spark.conf.get(name, None) == before


def test_sketches_of_long_sets_rule_out_pairs():
    """512 bins can't show that two sets of 4,000 shingles are apart: they differ in 650 and may still link."""
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(k)) for k, n in enumerate((4000, 4100, 40, 500, 530, 0))]
    sets += [np.sort(np.append(sets[3], sets[4][:40])), np.sort(np.append(sets[1][:-300], sets[0][:200]))]
    counts = np.array([len(s) for s in sets])
    got = ngram_join.sketches(np.concatenate(sets), counts)
    assert [8 * len(s) for s in got] == [4096, 8192, 512, 512, 1024, 512, 1024, 4096]
    i, j = np.triu_indices(len(sets))
    far = ngram_join.apart([got[a] for a in i], [got[b] for b in j])
    for a, b, d in zip(i.tolist(), j.tolist(), far.tolist(), strict=True):
        differ = len(np.setxor1d(sets[a], sets[b]))
        assert d <= differ and (differ - d) % 2 == 0 and (differ or not d)
        if (a, b) in ((0, 1), (3, 4)):
            assert d > counts[a] + counts[b] - 2 * ngram_join.needed(counts[a], counts[b])
    assert ngram_join.apart([], []).tolist() == []


def test_texts_that_stay_are_not_shuffled(spark):
    """Where the ids that go are too many to be broadcast, all texts were shuffled for the join."""
    docs = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionAll(docs.where("doc_id < 20")).localCheckpoint()
    gone = spark.range(0, 4000, 40).select(F.col("id").alias("doc_id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = ngram_join.without(docs, gone)
        assert out.columns == docs.columns
        got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect())
        stay, joined = (p for p in out._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = [(r.doc_id is None, r.doc_id or 0, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id % 40]
    assert got == sorted(want)
    assert "Union" in stay and "ArrowEvalPython" in stay and "ArrowEvalPython" in joined


def test_phrases_read_each_text_once(spark, talk):
    """Every level cut all texts into words again, seventeen times in all."""
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(talk, "lang string, text string").repartition(6).mapInArrow(watched, "lang string, text string")
    got = phrases.collocations(docs, 3, top=25, block=40, announced_by=1)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(talk, 3, 25)
    assert read.value == len(talk)


def test_codes_keep_neighbours_and_cut_at_rare_words():
    texts = ["a b c. d e", "", "f", "a x b c; x. é é", "."]
    pieces = phrases.Pieces(*string_parts(pa.array(texts)))
    assert pieces.texts(np.array([0, 6, 11])).to_pylist() == ["a", "a", "é"]
    bits, rare = 20, Words(*string_parts(pa.array(["x"]))).hashes()[0]
    known = np.full((1 << bits) // 8, 255, np.uint8)
    for cut, kept, left in ((False, "a b c d e a x b c é é", [3, 2, 1, 2, 1, 4, 3, 2, 1, 2, 1]), (True, "a b c d e b c é é", [3, 2, 1, 2, 1, 2, 1, 2, 1])):
        if cut:
            at = int(rare >> np.uint64(64 - bits))
            known[at >> 3] &= 255 - (1 << (at & 7))
        codes = phrases.Codes.of(pieces.hash, pieces.row, pieces.left > 1).often(known, bits)
        (batch,) = phrases._coded(phrases._OFTEN_ARROW, pa.array(["l0", "l1", "l2", "l3", "l4"]), codes)
        assert batch.column("lang").to_pylist() == ["l0", "l3"]
        (langs, again), = phrases._read([batch])
        assert again.hash.tolist() == (Words(*string_parts(pa.array(kept.split()))).hashes() & ~phrases._MORE).tolist()
        assert again.left.tolist() == left and again.row.tolist() == sorted(again.row.tolist())


def test_symbols_are_places_among_the_words():
    rng = np.random.default_rng(3)
    for n in (1, 2, 300):
        known = np.unique(np.append(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2), np.arange(n, dtype=np.uint64)))
        trie = phrases.DoubleArray(["en"] * len(known), known[:, None], np.arange(len(known)))
        asked = np.append(known, [np.uint64(5000), np.uint64((1 << 64) - 1)])
        assert trie._symbols(asked).tolist() == [*range(len(known)), -1, -1]

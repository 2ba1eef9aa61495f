"""The numbered operators against plain versions, on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailspan.llm import decontaminate, exact_dedup, html_text, language_id, mixing, ngram_join, quality, substring_dedup, token_store, warc
from trailspan.llm.common import Words, rolling, scratch_path, string_parts
from trailspan.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns beside doc_id and text whose names clash with those the operators use inside.
EXTRA = "n long, key long, t string, words string, label string, rate double, row long, fp long, part int, lang_pred string"


def table(spark, rows, extra=True):
    """doc_id, text and (with ``extra``) columns of clashing names."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, None, 1, "x", None, "y", 2.0, None, 3, 4, "z") for r in rows], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def awkward():
    """Documents with shared passages, near copies, repeats, nulls, and a very long text."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["Über", "naïve", "日本", "x,", "\x00"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = prose(70), prose(55)
    rows = [(k, prose(rng.randint(1, 220))) for k in range(60)]
    rows += [(100 + k, f"{prose(rng.randint(0, 40))} {passage}\n{prose(rng.randint(0, 30))}") for k in range(12)]
    rows += [(130 + k, f"{other}\t{other} {prose(5)}") for k in range(3)]
    rows += [(150, None), (151, ""), (152, " \n\t "), (153, "one"), (154, "one two three"), (155, "ONE two three"), (None, passage), (None, None)]
    rows += [(160, passage), (160, passage), (161, "a " * 3000), (162, "a " * 3000), (163, prose(30_000))]
    base = prose(150).split()
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((200 + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_words_and_rolling_hashes():
    texts = ["a b  c", None, "", " é\tb ", "a\x0bb\x0cc", " x"]
    data, offsets = string_parts(pa.array(texts))
    words = Words(data, offsets)
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    by = dict(zip([w for t in texts for w in WORD.findall(t or "")], words.hashes().tolist(), strict=False))
    assert len(set(by.values())) == len(by)
    values = np.arange(20, dtype=np.uint64)
    assert rolling(np.tile(values, 2), 5, 0xB5297A4D3F84D5B5)[3] == rolling(np.tile(values, 2), 5, 0xB5297A4D3F84D5B5)[23]
    assert len(rolling(values, 21, 3)) == 0


def plain_substring(rows, size):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            k = tuple(w[i:i + size])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i:i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 5])
def test_substring_dedup(spark, awkward, size):
    docs = table(spark, awkward).repartition(7)
    got = substring_dedup.remove_repeats(docs, size, flush_words=5000).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain_substring(awkward, size)
    for r in got:
        assert all(a.hi < b.lo for a, b in zip(r.spans, r.spans[1:], strict=False))
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


PAGE = """<html><head><title>T</title><script>x = "</p><p>no"</script><style>p{}</style></head><body>
<header><h1>Site</h1><p>A rather long slogan that says nothing of use to any reader at all.</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this long sentence even longer, for your own good.</p></div>
<div id=wrap><div class="post-body"><h1>Fish &amp; Chips</h1><p><b>First   paragraph,\n with <i>marks</i> &lt;here&gt; and enough words to count.<br>Same block<p>Second
paragraph is as long as the first, since the article has to win over the other parts.</p><p>Ja.</p><ul><li>item one of the list</li><li>item two</li></ul>
<div class="advert"><p>Buy this now, it is very cheap and you will never have to buy another one again.</p></div>
<p>The last paragraph closes the article, with&nbsp;a few more words than needed for it.</p></div>
<aside><p>Related stories that are long enough to look like prose to a careless program.</p></aside>
<form><label>Mail</label><input><textarea>x</textarea><button>Go</button></form>
<section id="comments"><p>I disagree with every single word of this article, said a reader at great length.</p></section></div>
<footer>&copy; 2020 Site, all rights reserved, contact, imprint</footer>"""


def test_html_extraction(spark):
    want = "\n\n".join([
        "Fish & Chips", "First paragraph, with marks <here> and enough words to count. Same block",
        "Second paragraph is as long as the first, since the article has to win over the other parts.", "Ja.", "item one of the list", "item two",
        "The last paragraph closes the article, with a few more words than needed for it.",
    ])
    assert html_text.main_text(PAGE) == want
    article = "<nav><a href=x>menu</a></nav><article><h1>A title</h1><p>x</p><p>" + "word " * 200 + "</p></article><footer>f</footer>"
    assert html_text.main_text(article) == "A title\n\nx\n\n" + ("word " * 200).strip()
    wrapped = f'<body><form><div class="layout with-sidebar"><div class=header><h1>Site</h1></div>{article}<article class=comment><p>{"no " * 100}</p></article></div></form>'
    assert html_text.main_text(wrapped) == html_text.main_text(article)
    assert html_text.main_text(f'<div class="page no-ads"><h1>T</h1><p>{"w " * 90}</p><div style="display: none"><p>{"x " * 60}</p></div></div>') == "T\n\n" + ("w " * 90).strip()
    for empty in (None, "", "   ", "<p></p>", "<nav>only a menu</nav>", "<!-- c -->", "<script>1</script>", "<", "</p>", "<a"):
        assert isinstance(html_text.main_text(empty), str)
    assert html_text.main_text(None) == html_text.main_text("<nav>only a menu</nav>") == ""
    assert html_text.main_text("plain text without any tag") == "plain text without any tag"
    long = "<p>" + "y" * 1_000_000 + "</p>"
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, None, PAGE, 2), (None, "v", None, 3), (2, "w", long, 4)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_text(pages).collect()}
    assert got == {(1, "u"): (want, len(want)), (1, None): (want, len(want)), (None, "v"): ("", 0), (2, "w"): ("y" * 1_000_000, 1_000_000)}
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_text_to_tag_clusters():
    soft = html_text.smoothed(np.array([0.0, 0.0, 9.0, 0.0, 0.0]), 1.0)
    assert soft.argmax() == 2 and soft[1] > 0
    assert html_text.content_lines(np.array([1.0, 1, 90, 2, 80, 1, 1])).tolist()[2:5] == [True, True, True]
    assert html_text.content_lines(np.array([])).tolist() == []


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    rows = [(1, "http://a", "same"), (2, "http://b c\n", "same"), (3, None, "other\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "u", "é" * 200_000), (3, None, "other\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, same int")
    folder = scratch_path(spark, "test-warc")
    warc.write_archives(pages, folder, compress=compress, archive_bytes=1000)
    found = warc.read_archives(spark.read.parquet(folder)).collect()
    assert {r.kind for r in found} == {"record"}
    number = lambda s: None if s is None or s.endswith("None>") else int(s[len("<urn:x-record:"):-1])
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    got = sorted(((number(r.record_id), r.record_type, number(r.refers_to), r.payload_bytes, r.payload_digest) for r in found), key=str)
    want = []
    for p, _, h in rows:
        h = h or ""
        last = max((q for q, _, g in rows if (g or "") == h and q is not None), default=None)
        revisit = last is not None and p != last
        want.append((p, "revisit" if revisit else "response", last if revisit else None, len(h.encode()), digest(h)))
    assert got == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in found if r.record_type == "response"} == {h or "" for _, _, h in rows}
    limited = scratch_path(spark, "test-warc")
    warc.write_archives(pages, limited, least_bytes=10)
    kinds = {number(r.record_id): r.record_type for r in warc.read_archives(spark.read.parquet(limited)).collect()}
    assert kinds[1] == kinds[4] == kinds[5] == "response"
    empty = scratch_path(spark, "test-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark.read.schema("archive string, content binary").parquet(empty)).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_warc_salvage(compress):
    records = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:x-record:{k}>"), ("WARC-Block-Digest", "sha1:" + warc.digest_of(b"body %d" % k * 50))], b"body %d" % k * 50, compress) for k in range(6)]
    names = lambda raw: [x[3][0]["warc-record-id"][14:-1] if x[0] == "record" else x[0] for x in warc.salvage(raw)]
    assert names(b"".join(records)) == list("012345")
    broken = list(records)
    broken[1] = broken[1][:40] + bytes([broken[1][40] ^ 255]) + broken[1][41:]
    broken[3] = broken[3][:-12]
    raw = b"junk" + b"".join(broken) + b"\x1f\x8b\x08tail"
    assert names(raw) == ["gap", "0", "gap", "2", "gap", "4", "5", "gap"]
    covered = sorted((a, b) for _, a, b, _ in warc.salvage(raw))
    assert covered[0][0] == 0 and covered[-1][1] == len(raw) and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))
    assert list(warc.salvage(b"")) == []


def plain_sets(rows):
    out = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(s), min(least[root(i)], default=None) if s else d) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("hot_sets,hot_list,block", [(16, 200_000, 1024), (3, 200_000, 4), (2, 50, 3), (10**6, 0, 8)])
def test_ngram_join(spark, awkward, hot_sets, hot_list, block):
    docs = table(spark, awkward).repartition(5)
    got = ngram_join.similar_documents(docs, hot_sets=hot_sets, hot_list=hot_list, block=block, flush_words=4000)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain_components(awkward)


def test_ngram_join_of_a_large_group_and_of_nothing(spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(500)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    got = ngram_join.similar_documents(table(spark, rows, extra=False), hot_sets=8, block=16)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain_components(rows)
    assert ngram_join.similar_documents(table(spark, [])).count() == 0


def test_index_lists_skip_no_pair():
    rng = np.random.default_rng(1)
    n = rng.integers(5, 60, 400)
    pos = (rng.random(400) * (n * 0.15 + 1)).astype(int)
    i, j = ngram_join.list_pairs(n, pos)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and min(n[a] - pos[a], n[b] - pos[b]) >= ngram_join.needed(n[a], n[b])}
    assert got == want


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (300, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def plain_rates(tokens, p, targets, steps=400):
    a = (tokens[:, None] * p).T
    g = (a / tokens) @ a.T
    inverse = np.linalg.pinv(g + 1e-12 * np.trace(g) * np.eye(len(targets)))
    want = np.array(targets) / sum(targets) * tokens.sum()
    r = np.ones(len(tokens))
    for _ in range(steps):
        r = np.maximum(0, r - p @ (inverse @ (a @ r - want)))
    return r, a, want


def test_mixing_rates(spark):
    rng = np.random.default_rng(2)
    tokens, p = rng.integers(1, 500, 200).astype(float), rng.dirichlet([0.3, 0.3, 0.3], 200)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    slopes, seen = mixing.fit_rates(members, [0.7, 0.2, 0.1], steps=60)
    got = np.array([r.r for r in members.select(mixing._rate(F.col("tokens"), F.col("p"), slopes, 1.0).alias("r")).collect()])
    want, a, goal = plain_rates(tokens, p, [0.7, 0.2, 0.1])
    assert (got >= 0).all() and np.abs(a @ got - goal).max() <= 2e-3 * tokens.sum()
    assert np.abs(a @ want - goal).max() <= 2e-3 * tokens.sum()
    first = np.abs(np.array(seen[0]["expected"]) - goal).max()
    assert np.abs(np.array(seen[-1]["expected"]) - goal).max() < 0.05 * first


def test_mixing_classifier_and_edges(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        kind = ("clean", "poor", "toxic")[k % 3]
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(40)] + {"clean": ["okay"], "poor": ["###", "$$$"], "toxic": ["Idiot"]}[kind]
        rows.append((k, " ".join(words)))
        if k < 150:
            labels.append((k, kind))
    rows += [(900, None), (901, ""), (None, "alpha"), (902, "beta"), (902, "beta")]
    labels += [(900, "clean"), (None, "poor"), (1, None), (2, "no such domain")]
    docs, marked = table(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.mix(docs, marked, {"clean": 0.6, "poor": 0.3, "toxic": 0.1}).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in range(150, 300):
        assert max(("clean", "poor", "toxic"), key=lambda d: by[k][f"p_{d}"]) == ("clean", "poor", "toxic")[k % 3]
    assert by[900].tokens == by[901].tokens == 0 and by[900].rate == by[901].rate == 1.0
    share = [sum(r.rate * r.tokens * r[f"p_{d}"] for r in got) for d in ("clean", "poor", "toxic")]
    assert np.allclose(np.array(share) / sum(share), [0.6, 0.3, 0.1], atol=0.01)
    assert mixing.mix(table(spark, []), marked).count() == 0
    unlabelled = mixing.mix(docs, marked.limit(0)).collect()
    assert len(unlabelled) == len(rows) and all(r.rate >= 0 for r in unlabelled)


def test_quality(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(400):
        good = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = (lambda w: [x + "###" for x in w], lambda w: [x.upper() + "!!" for x in w], lambda w: [w[0]] * len(w))[k // 2 % 3]
        rows.append((k, " ".join(good if k % 2 else bad(good))))
        labels.append((k, k % 2))
    rows += [(900, None), (901, ""), (None, "w1 w2"), (902, "x " * 50_000)]
    docs = table(spark, rows)
    marked = spark.createDataFrame([x for x in labels if x[0] < 300] + [(5, None), (None, 1), (6, 7)], "doc_id long, quality int")
    model = quality.train(docs, marked)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.5) == (k % 2 == 1) for k in range(300, 400)]) >= 0.95
    assert got[900] == got[901] and 0.25 <= model.temperature <= 16
    assert {r.score for r in quality.score(docs, quality.train(docs, marked.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, marked.limit(0))).collect()} == {0.5}
    assert quality.score(table(spark, []), model).count() == 0


def test_index_vectors_pool_by_text():
    model = quality.Model(np.empty(0, np.uint64), np.zeros((0, 64)), *[np.zeros(0)] * 5, 0.0, 1.0)
    one = [model.features(*string_parts(pa.array([t])))[0] for t in ("b a !!", "a b a", "")]
    both = model.features(*string_parts(pa.array(["b a !!", "a b a", ""])))
    assert np.allclose(both, np.array(one)) and not both[2].any()


def plain_profile(texts, most):
    counts = defaultdict(int)
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            w = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = w[i:i + n]
                    if g.strip() and not (n == 1 and g == " "):
                        counts[g] += 1
    return sorted(counts, key=lambda g: (-counts[g], gram_number(g)))[:most]


def gram_number(g):
    value = 0
    for c in g:
        value = (value << 21) | (1 if c == " " else ord(c))
    return value


def test_language_profiles_and_prediction(spark):
    texts = {"en": ["the quick brown-fox, the dog", "the end of it"], "de": ["der schnelle Fuchs und der Hund", "das ÄUßERE Ende 12 der"]}
    rows = [(k, t, lang) for lang, ts in texts.items() for k, t in enumerate(ts)] + [(5, None, "en"), (6, "text", None)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, Score int").repartition(3)
    profiles = language_id.train_profiles(docs, profile=60)
    assert profiles == {lang: [gram_number(g) for g in plain_profile(ts, 60)] for lang, ts in texts.items()}
    ranks = language_id.Ranks(profiles)
    text = "und das Ende der Hunde"
    mine = plain_profile([text], 400)
    assert language_id.ranked(text).tolist() == [gram_number(g) for g in mine]
    want = {}
    for lang, ts in texts.items():
        theirs = plain_profile(ts, 60)
        want[lang] = sum(min(abs(theirs.index(g) - i), 60) if g in theirs else 60 for i, g in enumerate(mine))
    assert dict(zip(ranks.langs, ranks.distance(language_id.ranked(text)).tolist(), strict=True)) == want
    assert language_id.predict(text, ranks)[0] == "de" and language_id.predict("the fox of the end", ranks)[0] == "en"
    for nothing in (None, "", " ", "12 34 !", "_"):
        assert language_id.predict(nothing, ranks) == ("und", 0.0)
    awkward = docs.unionAll(docs.selectExpr("null", "repeat('der ', 100000)", "lang", "lang_pred", "score"))
    got = language_id.identify(awkward, profiles)
    assert got.columns == ["doc_id", "text", "lang", "Score", "lang_pred", "lang_score"]
    assert {r.text[:4]: r.lang_pred for r in got.collect() if r.doc_id is None} == {"der ": "de"}
    nobody = language_id.train_profiles(docs.limit(0))
    assert nobody == {} and {r.lang_pred for r in language_id.identify(docs, nobody).collect()} == {"und"}


def test_exact_dedup(spark, awkward):
    rows = awkward + [(300, "one \n two"), (301, "one two"), (302, " one two"), (303, "one\x0b\x0ctwo"), (304, "x" * 64 + "a"), (305, "x" * 64 + "b"), (306, "x" * 64 + "a")]
    docs = table(spark, rows)
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups[norm(t)].append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = [(d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)]) for d, t in rows]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_dedup_runs_no_python(spark, awkward):
    plan = exact_dedup.exact_duplicates(table(spark, awkward))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_token_store(spark, awkward):
    from tokenizers import Tokenizer

    rows = awkward + [(400, "It's <|endoftext|> done<|startoftext|>x 'll ΑΣ ΑΣ."), (401, "é ́a b c\x1cd")]
    docs, folder = table(spark, rows), scratch_path(spark, "test-tokens")
    token_store.write_tokens(docs, folder, shard_ids=5000)
    plain = Tokenizer.from_file(token_store.tokenizer_file(token_store.VOCABULARY))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, every = [], []
    for d, t in order:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    some = random.Random(1).sample(range(len(every)), 200) + [0, len(every) - 1, len(every), -1]
    read = {r.place: r.token for r in token_store.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in some], "place long")).collect()}
    assert read == {p: every[p] for p in some if 0 <= p < len(every)}
    none = scratch_path(spark, "test-tokens")
    token_store.write_tokens(table(spark, []), none)
    assert token_store.read_digests(spark, none).count() == 0


def test_directly_addressable_codes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        lengths = np.array([n // 2, n - n // 2])
        shard = token_store.Shard(token_store.Shard.packed(ids, lengths))
        assert (shard.all() == ids).all() and shard.ids == n
        assert [shard.token(i) for i in range(0, n, 3)] == ids[::3].tolist()
        assert (shard.document(1) == ids[n // 2:]).all()
        with pytest.raises(IndexError):
            shard.token(n)
    with pytest.raises(ValueError):
        token_store.Shard(b"something else")


def plain_matches(rows, items, similarity=0.8):
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    bags, df = {}, defaultdict(int)
    for i, t in items:
        w = split(t)
        if w:
            n = min(5, len(w))
            bags[i] = (len(w), n, [tuple(w[k:k + n]) for k in range(len(w) - n + 1)])
            for s in set(bags[i][2]):
                df[s] += 1
    weight = lambda s: 1 + np.log(len(items) / df[s]) if s in df else 1 + np.log(len(items))
    out = set()
    for d, t in rows:
        w = split(t)
        for i, (length, n, bag) in bags.items():
            for a in range(len(w) - length + 1):
                other = [tuple(w[k:k + n]) for k in range(a, a + length - n + 1)]
                if not set(other) & set(bag):
                    continue
                names = set(bag) | set(other)
                lo = sum(weight(s) * min(bag.count(s), other.count(s)) for s in names)
                hi = sum(weight(s) * max(bag.count(s), other.count(s)) for s in names)
                if lo >= similarity * hi - 1e-12:
                    out.add((d, i))
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    words = [f"q{k}" for k in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(prose(rng.randint(12, 60)))) for k in range(20)] + [(30, "q1 q2 q3"), (31, None), (32, "!!"), (None, "q9 q8 q7 q6 q5 q4")]
    rows = []
    for k in range(60):
        piece = items[k % 20][1].split()
        if k >= 20:
            piece[rng.randrange(len(piece))] = "zz"
        if k >= 40:
            piece[rng.randrange(len(piece))] = "yy"
        rows.append((k, " ".join(prose(rng.randint(0, 80)) + [x.upper() + "," for x in piece] + prose(rng.randint(0, 50)))))
    rows += [(100, None), (101, ""), (None, items[3][1]), (102, "Q1 (q2) q3"), (103, "q9 q8 q7 q6 q5 q4"), (104, " ".join(prose(30_000))), (105, items[4][1]), (105, items[4][1])]
    docs, bench = table(spark, rows), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == plain_matches(rows, items)
    assert {(k, k) for k in range(20)} <= {(r.doc_id, r.item_id) for r in got}
    flags = decontaminate.with_flag(docs.withColumn("Contaminated", F.lit("x")), bench)
    hit = {d for d, _ in plain_matches(rows, items)}
    assert {r.doc_id: r.contaminated for r in flags.collect()} == {d: d in hit for d, _ in rows}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert {r.contaminated for r in decontaminate.with_flag(docs, bench.limit(0)).collect()} == {False}
    blocks = decontaminate.contaminated(docs, bench, item_chars=300)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= {(k, k) for k in range(20)}


def short_matches(rows, items, similarity=0.8):
    """Items that a whole text is similar enough to, of texts with fewer words than the item, without weights."""
    split = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    out = set()
    for d, t in rows:
        for i, item in items:
            w, v = split(t), split(item)
            n = min(5, len(v))
            a, b = ({tuple(x[k:k + n]) for k in range(len(x) - n + 1)} for x in (w, v))
            if len(w) < len(v) and a and b and len(a & b) >= similarity * len(a | b):
                out.add((d, i))
    return out


def test_decontamination_of_texts_shorter_than_the_item(spark):
    rng = random.Random(4)
    # No two items share a shingle, so that all weights are equal.
    items = [(k, " ".join(f"i{k}x{rng.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([50, 50, 30, 12, 3, 4])]
    cut = lambda k, a, b: " ".join(items[k][1].split()[a:b])
    rows = [(0, cut(0, 0, 48)), (1, cut(1, 1, 50)), (2, cut(2, 2, 29)), (3, cut(3, 0, 11)), (4, cut(4, 0, 2)), (5, cut(5, 0, 3)), (6, cut(0, 0, 30)), (7, cut(0, 0, 4)), (8, cut(0, 5, 49) + " " + cut(1, 0, 1)), (None, cut(0, 1, 49))]
    rows += [(10 + k, f"{cut(2, 0, 20)} other {cut(2, 21, 29)}") for k in range(2)]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == short_matches(rows, items) >= {(0, 0), (1, 1), (2, 2), (3, 3), (None, 0)}
    first = next(r for r in got if r.doc_id == 0)
    assert (first.first_word, first.n_words) == (0, 48) and abs(first.similarity - 44 / 46) < 1e-9
    hit = {d for d, _ in short_matches(rows, items)}
    assert {r.doc_id: r.contaminated for r in decontaminate.with_flag(docs, bench).collect()} == {d: d in hit for d, _ in rows}


def test_decontamination_weights_are_those_of_the_whole_benchmark(spark):
    rng = random.Random(12)
    words = [f"q{k}" for k in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [prose(12) for _ in range(3)]
    items = [(k, " ".join(shared[k % 3] + prose(12 + k % 5))) for k in range(24)] + [(30, None), (31, "q1 q2"), (32, "q1 q2")]
    rows = []
    for k in range(24):
        w = items[k][1].split()
        for edits in range(1, 4):  # near the limit, in the rare part, in the shared one, with another item's words
            a, b = list(w), list(w)
            for _ in range(edits):
                a[12 + rng.randrange(len(w) - 12)] = "zz"
                b[rng.randrange(12)] = "yy"
            rows += [(len(rows), " ".join(prose(9) + a + prose(9))), (len(rows) + 1, " ".join(b)), (len(rows) + 2, " ".join(w[:-edits - 2] + shared[(k + 1) % 3][:edits + 6]))]
    docs, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for item_chars in (1, 300, 900, 10**9):
        got = decontaminate.contaminated(docs, bench, item_chars=item_chars).collect()
        seen.append(sorted((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word, r.n_words) for r in got))
        if item_chars in (300, 900):
            flags = decontaminate.with_flag(docs, bench, item_chars=item_chars).collect()
            assert {r.doc_id for r in flags if r.contaminated} == {r[0] for r in seen[-1]}
    assert seen[0] and all(x == seen[-1] for x in seen)


def test_quality_learns_behind_a_very_long_text_and_from_all_texts(spark):
    rows = [(k, f"good{k % 7} fine words here" if k % 2 else f"bad{k % 7} ### words") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100, 1), (101, 0)], "doc_id long, quality int")
    first = labels.orderBy(F.xxhash64("doc_id")).first().doc_id
    rows = [(d, "long text " * 1_200_000 if d == first else t) for d, t in rows] + [(200 + k, "unlabelled pair") for k in range(5)] + [(300, None)]
    docs = table(spark, rows).repartition(3)
    model = quality.train(docs, labels)
    assert model.constant is None
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 2 == 1) for k in range(60) if k != first]) >= 0.95
    # Word vectors against a plain sum over all texts, also with many small flushes.
    small = [(d, t) for d, t in rows if d != first]
    names, context = quality.word_vectors(table(spark, small).repartition(4), flush_tokens=20)
    want, seen = defaultdict(lambda: np.zeros(quality.DIMENSIONS)), defaultdict(int)
    for _, t in small:
        h = quality.tokens(*string_parts(pa.array([t], pa.large_string())))[0]
        for i in range(len(h)):
            seen[h[i]] += 1
            for step in (-2, -1, 1, 2):
                if 0 <= i + step < len(h):
                    place, value = quality.index_vectors(h[i + step:i + step + 1])
                    np.add.at(want[h[i]], (place[0] + step) % quality.DIMENSIONS, value[0])
    assert names.tolist() == sorted(seen) and all(np.allclose(v, want[n] / (4 * seen[n]), atol=1e-6) for n, v in zip(names, context, strict=True))


def test_exact_dedup_query_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b"), (1, "a  b"), (1, "other"), (2, "a\nb"), (None, "a b"), (None, None), (3, ""), (4, "x" * 5000 + "a"), (4, "x" * 5000 + "b"), (5, "x" * 5000 + "a"), (5, "x" * 5000 + "b"), (6, "single")]
    table(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = [(d, keep[norm(t)], len(groups[norm(t)]), d == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows]
    got = exact_dedup.op8_exact_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

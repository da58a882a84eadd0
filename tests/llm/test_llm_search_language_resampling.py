"""Lexical search, language identification and importance resampling against brute-force versions and odd rows."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quillspark.llm import importance, language, lexical, queries  # noqa: E402
from quillspark.llm.common import ascii_words  # noqa: E402

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
TEXTS = [None, "", " \n\t!?", "a", "one two three", LONG, LONG + " end", "same words here and there", "same words here and there", "same words here and there",
         "é ñ 日本 ß\u0085x\xa0y İstanbul", "ÀÉ Àé aé", "x" * 5000, "the the the of of rare", "the of", "rare the", "A_b-c 1.5 a_B", "́", "123 456 !"]
#: Columns whose names clash with those the operators use inside or give.
MORE = "id long, row long, n long, terms string, counts string, totals string, text2 string, score string, rank string, lang_pred string, hash long, label string, rejected string, weight string, n_features string, planes string, part long, number long, item long"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(fold(text))


def frame(spark, rows, key="doc_id"):
    more = (None,) * len(MORE.split(","))
    return spark.createDataFrame([(i, t, lang) + more for i, t, lang in rows], f"{key} long, text string, lang string, {MORE}")


def test_words_are_cut_alike_in_pieces():
    text = " ".join(TEXTS[k] or "" for k in range(len(TEXTS)))
    for piece in (1, 7, 1000, 1 << 20):
        assert [w.decode() for p in ascii_words(text.encode(), piece) for w in p] == words(text)


# ---------------------------------------------------------------- lexical search
def brute_search(docs, items, k):
    tf = [(i, Counter(words(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(c.total() for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for i, terms in wanted.items():
        found = []
        for d, c in tf:
            m = 10 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def test_search_odd_rows_and_clashing_columns(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "rare rare"), (None, "the rare rare rare")]
    items = [(0, "THE rare of"), (1, None), (2, " "), (3, "nothing-known"), (None, "same words"), (0, "à é 日本"), (4, "w5x w6x the"), (5, "\u0085x")]
    got = lexical.search(frame(spark, [(i, t, None) for i, t in docs]), frame(spark, [(i, t, None) for i, t in items], "item_id"), k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 3)


@pytest.mark.parametrize("block,bytes_,k", [(16, 1 << 20, 5), (64, 300, 1), (1000, 1 << 20, 40)])
def test_search_in_many_blocks(spark, monkeypatch, block, bytes_, k):
    """Blocks of documents and of items, hot and rare terms, copies with equal scores."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "ITEM_BYTES", bytes_)
    rnd = random.Random(block)
    vocabulary = [f"v{i}" for i in range(300)]
    pick = lambda n: " ".join(vocabulary[min(299, int(rnd.expovariate(0.02)))] for _ in range(n))
    texts = [pick(rnd.randint(1, 60)) for _ in range(250)]
    docs = list(enumerate(texts + [texts[7]] * 120 + [texts[8]] * 30))
    items = [(i, pick(rnd.randint(1, 30))) for i in range(12)] + [(12, texts[7])]
    d = frame(spark, [(i, t, None) for i, t in docs]).repartition(3)
    got = lexical.search(d, frame(spark, [(i, t, None) for i, t in items], "item_id"), k=k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, k)


def test_accumulators_stop_and_survivors_are_exact():
    rng = np.random.default_rng(3)
    n, terms = 4000, 30
    lists = [np.flatnonzero(rng.random(n) < 0.002 * 1.25**t) for t in range(terms)]
    doc = np.concatenate(lists)
    term = np.repeat(np.arange(terms), [len(x) for x in lists])
    order = np.lexsort((term, doc))
    ids = np.arange(n) * 3
    block = lexical.Block(ids, rng.integers(5, 200, n), np.bincount(doc, minlength=n), term[order].astype(np.int32), rng.integers(1, 9, len(doc)).astype(np.int32), terms, n, 100 * n)
    df = np.array([len(x) for x in lists])
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    by = np.argsort(df, kind="stable")
    full = np.zeros(n, dtype=np.int64)
    for t in by:
        span = slice(block.starts[t], block.starts[t + 1])
        full[block.docs[span]] += weight[t] * block.impacts[span]
    sums = np.zeros(n, dtype=np.int64)
    at, scores = block.search(lexical.Item(0, by, weight[by]), 10, np.zeros(0, dtype=np.int64), sums)
    assert not sums.any() and (scores == full[at]).all()
    best = np.lexsort((np.arange(n), -full))[:10]
    assert set(best) <= set(at.tolist()) and len(at) < (full > 0).sum() / 2


# ---------------------------------------------------------------- importance resampling
def brute_resample(docs, target, buckets, runs, percent, least, seed):
    def features(text):
        w = words(text)
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, runs + 1) for i in range(len(w) - r + 1))
    each = [(i, *features(t)) for i, t in docs]
    s, t = sum((c for _, _, c in each), Counter()), sum((features(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, n, c in each:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(m * gain[b] for b, m in c.items())
        rows.append([i, n, c.total(), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(r[0], *r[2:], rank.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize("buckets,runs,percent,least", [(10_000, 1, 10, 20), (61, 1, 50, 1), (128, 3, 100, 2)])
def test_resample_against_brute_force(spark, buckets, runs, percent, least):
    rnd = random.Random(5)
    texts = TEXTS + [" ".join(f"u{int(rnd.expovariate(0.05))}" for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(25, "u1 u2 " * 30), (None, "u3 u4 u5 " * 20)]
    target = ["u1 u2 u3 u1", None, "", "never seen é"]
    got = importance.resample(frame(spark, [(i, t, None) for i, t in docs]).repartition(3), frame(spark, [(i, t, None) for i, t in enumerate(target)], "item_id"),
                              buckets=buckets, runs=runs, percent=percent, least=least, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target, buckets, runs, percent, least, 7)


def test_runs_go_over_pieces(monkeypatch):
    monkeypatch.setattr(importance, "ascii_words", lambda t: ascii_words(t, 9))
    text = "ab cd ef gh ij kl mn op qr st uv"
    whole = importance.bucket_counts(text.encode(), importance._Buckets(97), 3)[1]
    monkeypatch.undo()
    assert (whole == importance.bucket_counts(text.encode(), importance._Buckets(97), 3)[1]).all()
    assert whole.sum() == 11 + 10 + 9


def test_planes_hold_the_numbers():
    counts = np.zeros(200, dtype=np.int64)
    counts[[0, 63, 64, 199]] = (1, 5, 1023, 70_000)
    planes = importance.slice_bits(counts)
    back = sum(np.unpackbits(p.view(np.uint8), bitorder="little")[:200].astype(np.int64) << k for k, p in enumerate(planes))
    assert len(planes) == 17 and (back == counts).all()
    assert importance.slice_bits(np.zeros(200, dtype=np.int64)).shape == (0, 4)


# ---------------------------------------------------------------- language
def plain_counts(text):
    """The bucket counts of a text, run by run, in plain integers."""
    out = Counter()
    chars = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in (c if language.unicodedata.category(c)[0] in "LM" else " " for c in text)) + " "
    for k in range(1, len(chars) - 1):
        if chars[k] != " ":
            for run, by in zip((chars[k], chars[k - 1 : k + 1], chars[k - 1 : k + 2]), language.MULTIPLIERS):
                h = sum((0 if c == " " else ord(c)) * m for c, m in zip(run, by)) % 2**32
                h ^= h >> 15
                out[(h * 0x2C1B3C6D % 2**32) >> (32 - (language.SIZE - 1).bit_length())] += 1
    return out


def plain_vector(text, idf):
    v = {b: (1 + math.log(n)) * idf[b] for b, n in plain_counts(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / norm for b, x in v.items()} if norm else v


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None and len(t) < 6000] + ["Straße, ÉTÉ", "\U0001F600 a\U00020000b"])
def test_grams_against_plain_counts(text, monkeypatch):
    monkeypatch.setattr(language, "PIECE", 5)
    counts = language.gram_counts(text)
    assert {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == dict(plain_counts(text))


def test_language_odd_rows_labels_and_clashing_columns(spark):
    known = [("the cat and the dog", "en"), ("the house and the tree", "en"), ("the cat and the dog", "en"), ("el gato y el perro", "es"), ("la casa y el gato", "es"), (None, "xx"), ("!!", "yy"), ("no label", None)]
    train = frame(spark, [(i, t, x) for i, (t, x) in enumerate(known)])
    model = language.train(train)
    assert set(model.languages) == {"en", "es"} and model.usual == "en"
    texts = [t for t, x in known if t and x in ("en", "es")]
    holds = Counter(b for t in texts for b in plain_counts(t))
    idf = {b: max(0.0, math.log((len(texts) + 1) / (holds[b] + 0.5))) for b in range(language.SIZE)}
    assert np.allclose(model.idf, [idf[b] for b in range(language.SIZE)])
    for j, name in enumerate(model.languages):  # one centroid each: the mean of the different texts, of length 1
        total = np.zeros(language.SIZE)
        for t in {t for t, x in known if x == name}:
            for b, w in plain_vector(t, idf).items():
                total[b] += w
        assert np.allclose(model.centroid(j), total / np.linalg.norm(total), atol=1e-5)
    asked = TEXTS + ["the tree", "el perro", "zzz qqq"]
    centroids = [model.centroid(j) for j in range(len(model.languages))]
    docs = frame(spark, list(zip(range(len(asked)), asked, ["fr"] * len(asked))))
    got = language.predict(docs, model)
    assert got.columns == [c for c in docs.columns if c not in language.OUTPUT] + list(language.OUTPUT)
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(asked):
        r = rows[i]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = plain_vector(t, idf)
        near = [sum(w * float(c[b]) for b, w in v.items()) for c in centroids]
        best = int(np.argmax(near))
        assert math.isclose(r["score"], min(max(near[best], 0.0), 1.0), abs_tol=1e-5)
        assert r["lang_pred"] == (model.languages[best] if near[best] > 0 else "en")
    assert rows[len(TEXTS)]["lang_pred"] == "en" and rows[len(TEXTS) + 1]["lang_pred"] == "es" and rows[len(TEXTS) + 2]["rejected"]


def test_language_without_training_rows(spark):
    docs = frame(spark, [(1, "some words", None), (2, None, None)])
    model = language.train(docs)
    assert [tuple(r) for r in language.predict(docs, model, carry=["doc_id"]).collect()] == [(1, "und", 0.0, True), (2, "und", 0.0, True)]


def test_copies_do_not_fill_the_sample(spark):
    """A text with very many copies counts once among the texts that centroids are fitted on."""
    rnd = random.Random(1)
    other = [" ".join(rnd.choice(["uno", "dos", "tres", "gato", "perro", "casa"]) for _ in range(12)) for _ in range(60)]
    docs = frame(spark, [(i, "copia copia copia", "es") for i in range(400)] + [(1000 + i, t, "es") for i, t in enumerate(other)])
    model = language.train(docs, rows=40)
    assert language.predict_text("gato perro casa uno", model)[1] > 0.5 and len(model.languages) == 1


def test_the_model_is_bounded_with_many_languages(spark, monkeypatch):
    """Each centroid keeps its heaviest coordinates where all would be more than the bound."""
    monkeypatch.setattr(language, "MODEL_BYTES", 4 * 8 * 30 * 70)
    rnd = random.Random(3)
    syllables = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(syllables[10 * (i % 30) : 10 * (i % 30) + 10]) for _ in range(12)), f"l{i % 30}") for i in range(600)]
    model = language.train(frame(spark, rows))
    assert len(model.weights) <= 30 * 4 * 70 and len(set(model.languages)) == 30
    assert sum(language.predict_text(t, model)[0] == x for _, t, x in rows) > 590


def test_several_centroids_and_outliers(spark):
    """A language in two scripts needs two centroids; letters of neither are rejected."""
    rnd = random.Random(2)
    latin = [" ".join(rnd.choice(["kuća", "mačka", "pas", "drvo", "reka", "more"]) for _ in range(14)) for _ in range(40)]
    cyrillic = [" ".join(rnd.choice(["кућа", "мачка", "пас", "дрво", "река", "море"]) for _ in range(14)) for _ in range(40)]
    english = [" ".join(rnd.choice(["house", "cat", "dog", "tree", "river", "sea"]) for _ in range(14)) for _ in range(40)]
    model = language.train(frame(spark, [(i, t, "sr" if i < 80 else "en") for i, t in enumerate(latin + cyrillic + english)]))
    assert model.languages.count("sr") > 1
    for text, name in (("мачка пас река море кућа", "sr"), ("mačka pas reka more kuća", "sr"), ("cat dog river sea house", "en")):
        assert language.predict_text(text, model)[0] == name
    assert language.predict_text("βγδ ζηθ κλμ", model)[2] and not language.predict_text(latin[0], model)[2]


def test_language_of_held_out_documents(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    got = queries.QUERIES["op12_nearest_centroid_language"](spark, d).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, all_ = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert all_ > 200 and right / all_ > 0.97

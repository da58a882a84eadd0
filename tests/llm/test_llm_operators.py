"""Each training-data operator against a brute-force version, over the smallest tables and over odd rows."""

import base64
import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quillspark.llm import ann, bpe, licences, mixing, quality_classifier, quality_rules, queries, secret_scan, sharding, simhash, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, shard int, word string, fp string, spans string, licence int, budget int, __key int"
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
ODD_TEXTS = [None, "", "   \n\t ", "a", "one two three", LONG, LONG + " end", "same words here and there", "same words here and there",
             "All rights reserved. CC BY cc by-nc 4.0; GNU General Public License, version 3.", "é ñ 日本 ß\u0085x\xa0y",
             'token: secret: abcdefghijklmnop password = "0123456789abcdef" AKIA0123456789ABCD' + " AKIAshort 00112233445566778899aa",
             "x" * 5000, "aaaa " * 300, "\n".join(["line one is here"] * 5), "password=" + "9f" * 40 + "\n" + "deadbeef" * 9]


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[k], t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, len(t or "")) + (None,) * 9 for k, (i, t) in enumerate(enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD_TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def small(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def tables(tmp, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{tmp}/{name}.parquet")
    return str(tmp)


def query(prefix):
    return next(f for k, f in queries.QUERIES.items() if k.startswith(prefix + "_"))


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory, odd):
    labels = spark.createDataFrame([(i, i % 2, int(i in (3, 9))) for i in range(14)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([(0, "words here and there, w5x"), (1, None), (2, ""), (None, "one two"), (3, LONG), (0, "rights reserved")], "item_id long, text string")
    return tables(tmp_path_factory.mktemp("odd") / "t", documents=odd, labels=labels, embeddings=vectors, benchmark=items)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory, empty):
    return tables(tmp_path_factory.mktemp("empty") / "t", documents=empty, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                  embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"), benchmark=spark.createDataFrame([], "item_id long, text string"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_and_odd_tables(spark, empty_dir, odd_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0
    found = queries.QUERIES[name](spark, odd_dir).collect()
    if name.split("_")[0] not in ("op6", "op8", "op11"):
        assert sorted(r["doc_id"] for r in found) == list(range(len(ODD_TEXTS)))


# op1


def xx(x, seed):
    h = xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), seed)
    return h


def xx_int(x, seed):
    return xxhash.xxh64_intdigest(int(x).to_bytes(4, "little", signed=True), seed)


def descend(key, tree):
    def draw(level, node, w):
        h = xx_int(node, xx_int(level, xx(key, 42)))
        return (-math.log(((h >> 11) + 0.5) / (1 << 53)) / w, node)
    weight = defaultdict(float)
    for s in tree:
        weight["region", s.region] += s.weight
        weight["rack", s.rack] += s.weight
    region = min(draw(1, r, weight["region", r]) for r in {s.region for s in tree})[1]
    rack = min(draw(2, k, weight["rack", k]) for k in {s.rack for s in tree if s.region == region})[1]
    return min(draw(3, s.shard, s.weight) for s in tree if s.rack == rack)[1]


def test_shards_descend_the_tree(spark, small, odd):
    for df in (small, odd):
        out = rows_of(sharding.shard_table(df, "doc_id", "text", sharding.layout(16), sharding.layout(17)))
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
        assert len(out) == len(texts)
        for k, r in out.items():
            assert r["size"] == len(texts[k]) + 1 and r["text_crc32"] == zlib.crc32(texts[k])
            assert r["shard"] == descend(k, sharding.layout(16)) and r["grown_shard"] in (r["shard"], 16)
            assert r["grown_shard"] == descend(k, sharding.layout(17))
        by = defaultdict(list)
        for r in out.values():
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_movement_stays_in_changed_subtrees(spark):
    tree = [sharding.Shard(r, 2 * r + k, 4 * r + 2 * k + s) for r in range(3) for k in range(2) for s in range(2)]
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 5 else 1.0) for s in tree]
    df = spark.range(4000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b"))
    place = {s.shard: s for s in tree}
    for r in df.where("a <> b").collect():
        assert place[r["b"]].region == 1  # only into (or within) the region that grew
    counts = Counter(r["b"] for r in df.collect())
    assert 2 * 4000 / 13 * 0.7 < counts[5] < 2 * 4000 / 13 * 1.3
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [])


# op2


@pytest.fixture(scope="module")
def encoding():
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_pieces_match_the_library(encoding):
    import regex
    words, library = encoding
    rnd = random.Random(5)
    texts = ["", "aaaa" * 50, "ab" * 700, "x" * 3000, " " * 900, "\n\n  x", "日本語" * 100, "é" * 333]
    texts += ["".join(rnd.choice(a) for _ in range(rnd.choice([1, 9, 70, 400]))) for a in ("aab", "thesandionerit ", "abc DEF.12", "".join(map(chr, range(33, 700)))) for _ in range(60)]
    for t in texts:
        pieces = [p.encode() for p in regex.findall(public_tokenizers.PATTERN, t)]
        assert np.frombuffer(b"".join(words.encode(pieces)), dtype="<u4").tolist() == library.encode_ordinary(t)


def test_bpe_one_merge_at_a_time_where_a_lower_rank_may_follow():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"ba": 400, b"baa": 299, b"aab": 500, b"ab": 450}
    words = bpe.Vocabulary(ranks)

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]
    rnd = random.Random(2)
    for n in (3, 20, 63, 64, 65, 200):
        for _ in range(20):
            piece = bytes(rnd.choice(b"aab") for _ in range(n))
            if piece not in ranks:
                assert np.frombuffer(words.encode([piece])[0], dtype="<u4").tolist() == plain(piece)


def test_bpe_long_unbroken_pieces(encoding):
    """The heap gives the same merges as the library and the rows; a megabyte without a break takes seconds."""
    import time
    words, library = encoding
    rnd = random.Random(3)
    for alphabet in ("ab", "thesandionrl", "".join(map(chr, range(97, 123))), "é日x", "a"):
        for n in (4097, 9000):
            piece = "".join(rnd.choice(alphabet) for _ in range(n))
            got = words.encode_long(piece.encode()).tolist()
            assert got == words.encode_wide(piece.encode()).tolist() == [t for t in np.frombuffer(words.encode([piece.encode()])[0], dtype="<u4").tolist()]
            assert got == library.encode_ordinary(piece) or alphabet == "é日x"
    began = time.time()
    piece = "".join(rnd.choice("thesandionrl") for _ in range(1_000_000)).encode()
    ids = np.frombuffer(words.encode([piece])[0], dtype="<u4")
    assert b"".join(words.tokens[i] for i in ids.tolist()) == piece and time.time() - began < 60


def test_bpe_ids_beyond_16_bits():
    """Vocabularies of any size: pairs are keyed by two whole ids."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 70_000, b"ba": 135_536, b"abab": 200_000, b"aab": 300_000}
    words = bpe.Vocabulary(ranks)
    for piece, want in ((b"ababa", [200_000, 97]), (b"aaba", [300_000, 97]), (b"bab", [98, 70_000])):
        assert np.frombuffer(words.encode([piece])[0], dtype="<u4").tolist() == want == words.encode_long(piece).tolist() == words.encode_wide(piece).tolist()


def test_bpe_query_round_trip(spark, small_dir, odd_dir, encoding):
    for d in (small_dir, odd_dir):
        out = rows_of(query("op2")(spark, d))
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            ids = encoding[1].encode_ordinary(r["text"] or "")
            got = out[r["doc_id"]]
            assert got["n_tokens"] == len(ids)
            assert got["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_read_ranks_matches_the_file(encoding):
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        assert len(encoding[0].ranks) == sum(1 for line in f if line.strip())
    assert encoding[0].tokens[encoding[0].ranks[base64.b64decode(b"IHRoZQ==")]] == b" the"


# op3


def plain_simhash(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_query(spark, small_dir, odd_dir):
    for d in (small_dir, odd_dir):
        out = rows_of(query("op3")(spark, d))
        fps = {r["doc_id"]: plain_simhash(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        assert {k: int(r["fingerprint"], 16) for k, r in out.items()} == fps
        assert {k: r["component_id"] for k, r in out.items()} == plain_components(fps, 4)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_pigeonhole_finds_every_component(spark, distance, monkeypatch):
    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for x in base[:20]:  # chains whose steps are as long as the distance, and a dense ball
        for _ in range(5):
            for b in rnd.sample(range(64), max(distance, 1)):
                x ^= 1 << b
            fps.add(x)
    for _ in range(150):
        x = base[0]
        for b in rnd.sample(range(20), 2):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    monkeypatch.setattr(simhash, "BLOCK", 40)  # deal hot values over blocks
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df, len(signed), distance)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()} if not edges.isEmpty() else {}
    want = plain_components({x: x & (1 << 64) - 1 for x in signed}, distance)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({x: found.get(x, x) for x in signed}) == groups(want)


def test_thresholds_use_the_whole_budget():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    for distance in range(1, 7):
        for total in (10**3, 10**6, 10**9):
            parts = simhash.plan(sample, total, distance)
            left = [p for p, _ in parts]
            assert len({b for p in left for b in p}) == sum(map(len, left)) and all(e >= 0 for _, e in parts)
            assert sum(e + 1 for _, e in parts) == distance + 1
    assert simhash.allocate([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 0)[1] == [0, 1, -1]


def test_one_row_of_each_group_stays(spark, small):
    out = simhash.deduplicated(small)
    fps = {r["doc_id"]: plain_simhash(r["text"]) for r in small.collect()}
    assert out.columns == small.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(plain_components(fps, 4).values()))
    twice = frame(spark, ["alpha beta gamma delta epsilon"] * 3 + ["zeta eta theta iota kappa"], ids=[7, 7, 8, None])
    assert sorted((r["doc_id"] or -1) for r in simhash.deduplicated(twice).collect()) == [-1, 7]


def test_each_component_keeps_a_row_where_keys_occur_again(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "zeta eta theta iota kappa", "lambda mu nu xi omicron")
    # 7: a copy of 3's text, and a text of its own; 1: the smallest key of two components
    df = frame(spark, [one, one, two, three, three, "pi rho sigma tau upsilon", "pi rho sigma tau upsilon"], ids=[3, 7, 7, 1, 8, 1, 9])
    out = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicated(df).collect())
    assert out == [(1, three), (1, "pi rho sigma tau upsilon"), (3, one), (7, two)]


# op4


def plain_rules(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def plain_markov(text, model, rules):
    at = {c: i for i, c in enumerate(secret_scan.ALPHABET)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= secret_scan.RUN_CHARS:
            score = sum(round(model[at[a] * len(at) + at[b]], 4) for a, b in zip(m[0], m[0][1:]))
            clear = abs(score - secret_scan.MARGIN) > 1e-6 and abs(score - secret_scan.RATE * len(m[0])) > 1e-6
            if score >= secret_scan.MARGIN and score >= secret_scan.RATE * len(m[0]) and clear:
                if not set(range(m.start(), m.end())) <= {i for a, _, b in rules if a < m.end() and m.start() < b for i in range(a, b)}:
                    out.append((m.start(), 3, m.end()))
    return out


def test_secret_spans(spark, small, odd):
    model = secret_scan.train(small)
    name = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for df in (small, odd):
        for r in secret_scan.scan(df.select("doc_id", "text"), model).withColumn("names", secret_scan.spans_text("spans")).collect():
            rules = plain_rules(r["text"] or "")
            assert [tuple(s) for s in r["base_spans"]] == rules
            assert r["names"] == name(sorted(rules + plain_markov(r["text"] or "", model, rules)))


def test_a_consumed_keyword_is_not_matched_again(spark):
    df = frame(spark, ["token: secret: abcdefghijklmnop", "SECRET='abc.def=ghi/jkl'", "tokens=short x"] + ["token=" + "Ab1" * 9 + "\n"] * 1)
    got = [[tuple(s) for s in r["s"]] for r in df.orderBy("doc_id").select(secret_scan.rule_spans(F.col("text")).alias("s")).collect()]
    assert got == [plain_rules(r["text"]) for r in df.orderBy("doc_id").collect()] and got[0] == []


def test_many_spans_in_one_text(spark):
    text = " é ".join(f"token={i:012d}{'ab' * 8}" for i in range(1500))
    got = frame(spark, [text]).select(secret_scan.rule_spans(F.col("text")).alias("s")).first()["s"]
    assert [tuple(s) for s in got] == plain_rules(text)


def test_random_strings_beat_identifiers_on_held_out_samples(spark, small_dir):
    rnd = random.Random(3)
    docs = spark.read.parquet(small_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = secret_scan.train(docs)
    secret = ["".join(rnd.choice(secret_scan.ALPHABET[:62]) for _ in range(28)) for _ in range(200)]
    plain = sorted({m for r in docs.collect() for m in re.findall(r"(?<![A-Za-z0-9+/_=-])[a-z]{16,}(?![A-Za-z0-9+/_=-])", r["text"])})[:200]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(secret + plain)], "doc_id long, text string")
    hit = {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(df, model).collect()}
    assert sum(hit[k] for k in range(200)) >= 180 and sum(hit[k] for k in range(200, len(hit))) <= 4


def test_random_runs_stay_beside_the_rules_they_overlap(spark, small_dir):
    rnd = random.Random(5)
    model = secret_scan.train(spark.read.parquet(small_dir.replace("sf0.001", "sf0.01") + "/documents.parquet"))
    draw = lambda n, of=secret_scan.ALPHABET[:62]: "".join(rnd.choice(of) for _ in range(n))
    ids = [f"{rnd.randrange(10**18, 10**19)}-{draw(40)}" for _ in range(50)] + [f"{draw(20, '0123456789abcdef')}{draw(40)}" for _ in range(50)]
    covered = ["0a1b2c3d4e5f60718293", f"token={draw(40)}", f"{'AKIA' + draw(30, 'ABCDEFGHIJKLMNOP0123456789')}", f"AKIA{draw(20, '0123456789')}{draw(20, 'abcdef')}"]
    df = spark.createDataFrame([(k, f"see {t} there") for k, t in enumerate(ids + covered)], "doc_id long, text string")
    got = rows_of(secret_scan.scan(df, model).withColumn("out", secret_scan.redact(F.col("text"), "spans")))
    whole = [(4, 3, 4 + len(t)) in {tuple(s) for s in got[k]["spans"]} and got[k]["out"] == "see [SECRET] there" for k, t in enumerate(ids)]
    assert all(got[k]["base_spans"] for k in got) and sum(whole) >= 95
    for k in range(len(ids), len(got)):
        assert got[k]["spans"] == got[k]["base_spans"]


def mixed_secrets(rnd):
    """Random strings beside, before, after, across and inside what the rules find, adjacent rule spans, and many of them."""
    draw = lambda n, of=secret_scan.ALPHABET[:62]: "".join(rnd.choice(of) for _ in range(n))
    hexes = lambda n: draw(n, "0123456789abcdef")
    forms = [lambda: draw(30), lambda: hexes(20), lambda: f"{hexes(18)}-{draw(24)}", lambda: f"{draw(24)}_{hexes(18)}", lambda: f"token={draw(25)}", lambda: f"x{draw(20)}token={draw(16)}.{draw(22)}",
             lambda: f"AKIA{draw(16, 'ABCDEFGH0123')}{hexes(16)}", lambda: f"{hexes(17)}AKIA{draw(16, 'QRSTUV0189')}", lambda: "plain words", lambda: f"password: 'é{draw(20)}'", lambda: f"{draw(18)}.{hexes(30)}=secret: {hexes(16)}"]
    return rnd.choice([" ", "  ", "é", ", "]).join(rnd.choice(forms)() for _ in range(rnd.randint(1, 25)))


def test_markov_spans_beside_rules_against_plain(spark, small_dir):
    rnd = random.Random(11)
    model = secret_scan.train(spark.read.parquet(small_dir.replace("sf0.001", "sf0.01") + "/documents.parquet"))
    texts = [mixed_secrets(rnd) for _ in range(120)] + ["".join(f"{secret_scan.ALPHABET[k % 60]}" for k in range(5200)) + " " + mixed_secrets(rnd)]
    got = rows_of(secret_scan.scan(frame(spark, texts), model).withColumn("out", secret_scan.redact(F.col("text"), "spans", chunk=7)))
    partly = covered = 0
    for k, t in enumerate(texts):
        rules = plain_rules(t)
        extra, alone = plain_markov(t, model, rules), plain_markov(t, model, [])
        covered += len(alone) - len(extra)
        partly += sum(any(a < y and x < b for a, _, b in rules) for x, _, y in extra)
        assert [tuple(s) for s in got[k]["spans"]] == sorted(rules + extra)
        at, out = 0, ""
        for a, _, b in sorted(rules + extra):
            out += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert got[k]["out"] == out + t[at:]
    assert partly > 50 and covered > 50


def test_long_runs_and_very_many_spans(spark):
    """A megabyte without a break and 100,000 spans in one text: seconds each, as the cost is in proportion."""
    import time
    rnd = random.Random(7)
    model = [0.7] * len(secret_scan.ALPHABET) ** 2
    texts = ["".join(rnd.choice(secret_scan.ALPHABET) for _ in range(1_000_000)), " ".join(["0123456789abcdef"] * 100_000)]
    began = time.time()
    got = rows_of(secret_scan.scan(frame(spark, texts), model).withColumn("out", secret_scan.redact(F.col("text"), "spans")))
    assert time.time() - began < 60
    assert (0, 3, 1_000_000) in {tuple(s) for s in got[0]["spans"]} and len(got[1]["base_spans"]) == 100_000
    assert got[1]["out"] == " ".join(["[SECRET]"] * 100_000)


def test_redaction(spark):
    df = frame(spark, ["a token=0123456789abcdef0 b", None, "nothing", "00112233445566778899 x 00112233445566778899"])
    out = df.select("doc_id", secret_scan.redact(F.col("text"), secret_scan.rule_spans(F.coalesce("text", F.lit("")))).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in out] == ["a [SECRET] b", None, "nothing", "[SECRET] x [SECRET]"]


# op5


def test_toxicity_on_held_out_labels(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.01")
    out = rows_of(query("op5")(spark, d))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for k, r in out.items())
    held = [(labels[k], r["predicted"]) for k, r in out.items() if r["held_out"] and k in labels]
    assert sum(y and p for y, p in held) >= 0.7 * sum(y for y, _ in held)
    assert sum(p and not y for y, p in held) <= 0.03 * len(held)


def test_noisy_or_and_places(spark):
    model = toxicity.Model({"scum": 20.0, "idio*": 11.5}, -12.0, 0.1)
    score, spans = toxicity.score_text("All fine. You SCUM! An idiot.\nyes", model, {})
    p = [1 / (1 + math.exp(-8)), 1 / (1 + math.exp(0.5))]
    want = 1 - 0.9 * (1 - p[0]) * (1 - p[1]) * (1 - 1 / (1 + math.exp(12))) ** 2
    assert abs(score - want) < 1e-9 and len(spans) == 1
    assert "All fine. You SCUM! An idiot.\nyes"[spans[0]["start"] : spans[0]["end"]].strip() == "You SCUM!"
    assert toxicity.score_text("", model, {}) == (pytest.approx(0.1), [])
    assert toxicity.terms("idiotic") == ["idiotic", "idioti*", "idiot*", "idio*"]


def plain_toxicity(rows, labels):
    """Every document's score, from a fit in dense matrices: a row a sentence, a column a word."""
    stem = lambda w: [w] + [w[:k] + "*" for k in range(min(8, len(w) - 1), 3, -1)]
    cut = lambda t: [set(re.findall(r"[^\W\d_]+", x.lower())) for x in re.findall(toxicity.SENTENCE, t or "")]
    truth = {}
    for k, y in labels:
        if k is not None and y in (0, 1):
            truth[k] = max(y, truth.get(k, 0))
    texts = {}
    for k, t in rows:
        if k in truth:
            texts.setdefault(k, t)
    sample = [(texts[k] or "", truth[k]) for k in texts]
    pos, neg = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    seen = Counter(), Counter()
    for t, y in sample:
        seen[y].update({x for w in set().union(*cut(t)) for x in stem(w)})
    words = {}
    for w in seen[0] | seen[1]:
        a, b = seen[1][w], seen[0][w]
        cells = ((a, pos, a + b), (b, neg, a + b), (pos - a, pos, pos + neg - a - b), (neg - b, neg, pos + neg - a - b))
        g2 = 2 * sum(x * math.log(x * (pos + neg) / (of * all_)) for x, of, all_ in cells if x)
        if a + b >= toxicity.LEAST and a + b < pos + neg and a * neg > b * pos and g2 >= toxicity.SIGNIFICANT:
            words[w] = 12 + math.log((a + 0.5) / (b + 0.5))
    names = sorted(words)
    spot = {w: i for i, w in enumerate(names)}

    def matrix(t):
        held = [{next((x for x in stem(w) if x in spot), None) for w in s} - {None} for s in cut(t)]
        return np.array([[float(n in h) for n in names] for h in held]).reshape(len(held), len(names))
    bags, start = [(matrix(t), y) for t, y in sample], np.array([words[n] for n in names])
    silent = [y for m, y in bags if not m.any()]
    leak = min(max((sum(silent) + 0.1) / (len(silent) + 1), 1e-4), 0.5)
    w, mean, square = start.copy(), 0.0, 0.0
    rate = lambda m: 1 / (1 + np.exp(12 - m @ w))
    for step in range(1, toxicity.STEPS + 1):
        grad = -toxicity.RIDGE * (w - start)
        for m, y in bags:
            p = rate(m)
            clean = (1 - leak) * np.prod(1 - p)
            grad = grad + (clean / max(1 - clean, 1e-9) if y else -1.0) * (p @ m)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w = w + toxicity.RATE * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
    return {k: 1 - (1 - leak) * float(np.prod(1 - rate(matrix(t)))) for k, t in rows}


def test_toxicity_scores_against_brute_force(spark):
    """Every document's score from the same sample: odd rows, repeated ids and sentences, labels that contradict."""
    rnd = random.Random(6)
    mild = ["morning", "window", "garden", "reading", "quiet", "letters", "river", "paper"]
    bad = ["scumbags", "scumfest", "idiots", "vermins"]
    say = lambda ws: " ".join(rnd.choice(ws) for _ in range(rnd.randint(2, 6))).capitalize() + rnd.choice([". ", "! ", "\n", "? "])
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        text = "".join(say(mild) for _ in range(rnd.randint(1, 6)))
        if toxic:
            text += (say(mild + bad * 4) + "You scumbags! ") * rnd.randint(1, 3) + say(mild)
        rows.append((i, text))
        labels += [(i, int(toxic))] * (1 + i % 2)
    labels += [(None, 1), (3, None), (999, 1), (8, 0)]
    rows += [(500, None), (501, ""), (502, "...!"), (503, "You scumbags, VERMINS. " * 30), (504, "A quiet garden.")]
    model = toxicity.train(frame(spark, [t for _, t in rows], [i for i, _ in rows]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = rows_of(toxicity.score(frame(spark, [t for _, t in rows], [i for i, _ in rows]), model))
    want = plain_toxicity(rows, labels)
    assert len(model.words) > 3 and all(abs(got[k]["toxicity"] - want[k]) < 1e-4 for k in want)
    assert got[503]["toxicity"] > 0.9 > 0.1 > got[504]["toxicity"] and len(got[503]["offending"]) == 30


def test_a_labelled_id_that_repeats_is_learnt_once(spark):
    docs = frame(spark, ["You scum. Fine."] * 300 + ["A river."] * 300, [1] * 300 + list(range(2, 302)))
    labels = spark.createDataFrame([(1, 1)] * 50 + [(i, 0) for i in range(2, 302)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).words == {}   # one toxic document is no evidence, however often it stands there


def test_toxicity_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd, none) == toxicity.Model({}, leak=0.0)


# op6


def plain_mix(rows, weights, share, epochs, seed):
    def weight(level, name):
        return weights.get(level, {}).get(name, 1)

    def deal(names, level, given, caps):
        out, open_ = {}, [n for n in names if weight(level, n) > 0]
        while open_:
            per = given / sum(weight(level, n) for n in open_)
            full = [n for n in open_ if caps[n] <= per * weight(level, n)]
            if not full:
                return out | {n: per * weight(level, n) for n in open_}
            for n in full:
                out[n], given = caps[n], given - caps[n]
            open_ = [n for n in open_ if n not in full]
        return out
    tree = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for r in rows:
        tree[r["domain"]][r["lang"]][r["source"]].append(r)
    size = lambda node: sum(r["tokens"] for r in node) * epochs if isinstance(node, list) else sum(size(v) for v in node.values())
    taken, leaf_budgets = Counter(), {}
    total = int(sum(r["tokens"] for r in rows) * share)
    for dom, b1 in deal(list(tree), "domain", total, {k: size(v) for k, v in tree.items()}).items():
        for lang, b2 in deal(list(tree[dom]), "lang", b1, {k: size(v) for k, v in tree[dom].items()}).items():
            for src, b3 in deal(list(tree[dom][lang]), "source", b2, {k: size(v) for k, v in tree[dom][lang].items()}).items():
                leaf, left, epoch = tree[dom][lang][src], b3, 0
                leaf_budgets[dom, lang, src] = b3
                each = sum(r["tokens"] for r in leaf)
                while each and left >= each - 1e-6 and epoch < epochs:
                    for r in leaf:
                        taken[r["doc_id"], epoch] += 1
                    left, epoch = left - each, epoch + 1
                key = lambda r: hashlib.md5(f"{seed}:{epoch}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()  # noqa: E731,B023
                before = 0
                if left > 1e-6:
                    for r in sorted(leaf, key=key):
                        if before >= left:
                            break
                        taken[r["doc_id"], epoch] += 1
                        before += r["tokens"]
    return taken, leaf_budgets


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.8, 3), (1.5, 2), (0.05, 2), (3.0, 2)])
def test_mix(spark, small, share, epochs):
    tokens = mixing.whitespace_tokens(F.col("text"))
    got = mixing.mix(small, mixing.domain_of(F.col("source")), tokens, queries.WEIGHTS, share, epochs, 9).collect()
    rows = [r.asDict() for r in small.select("doc_id", "lang", "source", mixing.domain_of(F.col("source")).alias("domain"), tokens.alias("tokens")).collect()]
    assert sum(r["tokens"] for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in small.collect())
    taken, budgets = plain_mix(rows, queries.WEIGHTS, share, epochs, 9)
    assert Counter((r["row"]["doc_id"], r["epoch"]) for r in got) == taken
    for r in got:
        assert r["budget"] == pytest.approx(budgets[r["domain"], r["lang"], r["source"]])


def test_mix_odd_rows(spark, odd, empty):
    tokens = mixing.whitespace_tokens(F.col("text"))
    out = mixing.mix(odd, F.lit(None).cast("string"), tokens, {}, 5.0, 2, 1)
    with_words = [r["doc_id"] for r in odd.collect() if (r["text"] or "").split()]
    assert Counter(r["row"]["doc_id"] for r in out.collect() if r["tokens"]) == Counter({k: 2 for k in with_words})
    assert mixing.mix(empty, F.lit("d"), tokens, {}, 1.0, 1, 1).count() == 0
    one = frame(spark, ["a b c", "a b c", "d e f"], ids=[1, 1, None]).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    assert mixing.mix(one, F.lit("d"), tokens, {"lang": {"en": 0}}, 1.0, 1, 1).count() == 0
    assert mixing.mix(one, F.lit("d"), tokens, {}, 1.0, 1, 1).count() == 3


# op7


def test_licence_base_places(spark, small_dir, odd_dir):
    for d in (small_dir, odd_dir):
        out = rows_of(query("op7")(spark, d))
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            places = sorted((i, k) for k, p in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
            got = out[r["doc_id"]]
            assert (got["n_words"], got["n_base"]) == (len(words), len(places))
            assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert got["base_labels"] == ",".join(sorted({k for _, k in places}))
            assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1


def test_licence_notices():
    index = licences.Index({"the": 90, "license": 3, "licensed": 4, "version": 5}, 100)
    found = lambda t: index.scan(licences.words_of(t.encode()))[1]
    assert found("x Licensed under the Apache License, Version 2.0.")["apache-2.0"] == 1.0
    assert "apache-2.0" not in found("Licensed under the Apache License, no version")
    assert {"gpl", "gpl-3.0"} == set(found("licensed under the GNU General Public License, version 3"))
    assert set(found("Licensed under CC BY-NC 4.0.")) == {"cc-by", "cc-by-nc"}
    assert found("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")["mit"] >= 0.6
    assert index.scan([])[0] == [] and found("all all rights reserved rights") == {"reserved": 1.0}


def plain_labels(index, words):
    """Every label whose template has enough of its rarest words in one alignment somewhere and passes there: all places tried."""
    out = {}
    for t, (label, notice, phrases, least, whole) in enumerate(index.templates):
        if whole:
            if any(words[i : i + len(notice)] == notice for i in range(len(words))):
                out[label] = 1.0
            continue
        rare = {(w, p) for w, hits in index.postings.items() for k, p in hits if k == t}
        votes = [(i - p, p) for w, p in rare for i, x in enumerate(words) if x == w]
        for s, p in votes:
            if least == 1 or any(q != p and abs(s - r) <= licences.SLACK for r, q in votes):
                near = words[max(0, s - licences.SLACK) : max(0, s + len(notice) + licences.SLACK)]
                rows = [[0] * (len(near) + 1) for _ in range(len(notice) + 1)]
                for a, x in enumerate(notice):
                    for b, y in enumerate(near):
                        rows[a + 1][b + 1] = rows[a][b] + 1 if x == y else max(rows[a][b + 1], rows[a + 1][b])
                text = b" " + b" ".join(near) + b" "
                share = rows[-1][-1] / len(notice)
                if share >= licences.LEAST_SCORE and all(b" " + b" ".join(f) + b" " in text for f in phrases):
                    out[label] = max(share, out.get(label, 0.0))
    return out


def test_licence_labels_against_every_place(small_dir):
    rnd = random.Random(8)
    index = licences.Index({"the": 90, "license": 30, "of": 95, "and": 90, "is": 70, "this": 60, "to": 90, "software": 20, "version": 9, "free": 12}, 100)
    notices = [n for _, n, _ in licences.NOTICES] + list(licences.BASE.values())
    some = [w for n in notices for w in n.split()]
    labels = 0
    for _ in range(250):
        text = []
        for _ in range(rnd.randint(1, 3)):
            words = rnd.choice(notices).split()
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):   # words put in, left out, exchanged
                i = rnd.randrange(len(words))
                words[i : i + rnd.randrange(2)] = [rnd.choice(["new", rnd.choice(some)])] * rnd.randrange(2)
                words = words or ["x"]
            text += [rnd.choice(some) for _ in range(rnd.randint(0, 6))] + words
        words = " ".join(text).encode().split()
        got = index.scan(words)[1]
        assert got == plain_labels(index, words)
        labels += len(got)
    assert labels > 250


def test_headers_titles_and_identifiers_are_labelled():
    index = licences.Index({}, 0)
    found = lambda t: set(index.scan(licences.words_of(t.encode()))[1])
    header = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert found(header.format("This program", "", "3")) == {"gpl", "gpl-3.0"} and found(header.format("Tool", "", "2")) == {"gpl", "gpl-2.0"}
    assert found(header.format("It", "Affero ", "3")) == {"gpl", "agpl-3.0"} and found(header.format("It", "Lesser ", "2.1")) == {"gpl", "lgpl"}
    assert found("Mozilla Public License Version 2.0\n====") == {"mpl-2.0"} and found("BSD 3-Clause License") == {"bsd-3-clause"}
    assert found("// SPDX-License-Identifier: MIT") == {"mit"} and found("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3.0"}
    assert index.scan(licences.words_of(b"The MIT License (MIT)"))[1] == {"mit": 1.0}
    assert found("Licensed under the well known Apache License, Version 2.0") == {"apache-2.0"}
    assert found("a license of the version we use in public software") == set()


def test_licences_in_a_long_text_of_near_misses():
    import time
    index = licences.Index({}, 0)
    words = licences.words_of(b"permission hereby granted to a person with software files free of charge " * 20_000 + b"isc license")
    began = time.time()
    assert index.scan(words)[1] == {"isc": 1.0} and time.time() - began < 60


# op8


def plain_nearest(rows, k):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    seen = {(i, tuple(v)) for i, v in rows if i is not None and ok(v)}
    for q, v in sorted({(i, v) for i, v in seen if i % 20 == 0}):
        best = sorted((math.dist(v, w), i) for i, w in seen if i != q and len(w) == len(v))[:k]
        yield q, v, best


def test_neighbours_exact_on_a_small_table(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).round(3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(60)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] * 4), (480, [1.0, float("inf")] * 4), (None, rows[3][1]), (500, [1.0, 2.0])]
    rows += [rows[20]]
    rows += [(1000 + i, rnd.normal(size=5).round(3).tolist()) for i in range(90)] + [(2000 + i, [float(i)]) for i in range(30)]  # other lengths
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, v array<double>, cell string, block int")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, "id", "v", 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["id"], r["rank"]))
    want = {q: best for q, _, best in plain_nearest(rows, 5) if best}
    assert set(got) == set(want) and {500, 1000, 1080, 2020} - set(got) == {500}  # the only vector of length 2 has no neighbour
    hits = total = 0
    for q, best in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, len(best) + 1))
        assert [(s, i) for s, i, _ in got[q]] == sorted((s, i) for s, i, _ in got[q])
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
        total += len(best)
    assert hits >= 0.9 * total
    assert [i for _, i, _ in got[40]] == [300, 301, 302, 303, 304] and [i for _, i, _ in got[300]] == [40, 301, 302, 303, 304]


def test_queries_of_a_block_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "ASKS", 7)
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.normal(size=6).tolist()) for i in range(200)]
    got = ann.nearest(spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 2 == 0, "id", "v", 3).collect()
    want = {q: best for q, _, best in ((q, v, sorted((math.dist(v, w), i) for i, w in rows if i != q)[:3]) for q, v in rows if q % 2 == 0)}
    assert len(got) == 300 and sum(r["id"] in {i for _, i in want[r["query_id"]]} for r in got) >= 270


def test_neighbours_recall_on_the_table(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    got = defaultdict(list)
    for r in query("op8")(spark, d).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    data = table.orderBy("vec_id").toPandas()
    ids, v = data["vec_id"].to_numpy(), np.stack(data["embedding"].to_numpy()).astype(np.float64)
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        dist = np.sqrt(((v - v[k]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, dist)) if j != k][:10]
        hits += len(set(ids[order]) & {i for i, _ in got[ids[k]]})
        total += 10
        assert all(abs(s - dist[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in got[ids[k]])
    assert hits >= 0.9 * total


def test_heap_order_is_by_summed_distance():
    index = ann.MultiIndex(np.random.default_rng(0).normal(size=(600, 6)))
    a, b = (x[0] for x in index.distances(np.ones((1, 6))))
    cells = list(index.order(a, b))
    assert len(cells) == len(set(cells)) == len(a) * len(b)
    sums = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert sums == sorted(sums)


# op9


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, small_dir, odd_dir):
    for d in (small_dir, odd_dir):
        out = rows_of(query("op9")(spark, d))
        for r in spark.read.parquet(f"{d}/documents.parquet").collect():
            got, want = out[r["doc_id"]], plain_statistics(r["text"])
            assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert got["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (got["base_failed"] and got["kept"])


def plain_mcd(x, half, steps):
    """The same starts and concentration steps with numpy, for one group: distances, the start that was kept, and its determinant."""
    d = x.shape[1]
    floor = np.diag(np.square(quality_rules.FLOOR))

    def moments(near, factor):
        return near.mean(axis=0), np.cov(near.T, bias=True) * factor + floor

    def distance(model):
        y = x - model[0]
        return (y * np.linalg.solve(model[1], y.T).T).sum(axis=1)

    def step(model, share):
        dist = distance(model)
        return moments(x[dist <= np.quantile(dist, share, method="lower")], share / quality_rules._chi2_cdf(quality_rules.chi2_quantile(share, d), d + 2))
    mid = np.median(x, axis=0)
    scale = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, quality_rules.FLOOR)
    z = (x - mid) / scale
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    models = [(mid, np.diag(scale**2)), moments(x, 1.0), moments(mid + scale * z * math.sqrt(d) / np.where(norm > 0, norm, 1), 1.0)]
    for n in range(steps):
        models = [step(m, half if n else 0.5) for m in models]
    dets = [np.linalg.slogdet(m[1])[1] for m in models]
    start, model = int(np.argmin(dets)), models[int(np.argmin(dets))]
    for _ in range(quality_rules.MOST_STEPS):
        new = step(model, half)
        change = np.linalg.slogdet(model[1])[1] - np.linalg.slogdet(new[1])[1]
        model = new if change > 0 else model
        if abs(change) <= quality_rules.SETTLED:
            break
    return distance(model), start, np.linalg.slogdet(model[1])[1]


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def vectors(df):
    return np.array([[r[f] for f in quality_rules.FEATURES] for r in quality_rules.transformed(df).orderBy("doc_id").collect()])


def test_each_statistic_can_reject_alone(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, "en", "s", w := int(np.exp(rnd.normal(5, 0.5))) + 40, int(w * np.exp(rnd.normal(1.6, 0.05))), 0, int(rnd.random() < 0.02), 20, 0) for i in range(800)]
    odd = {801: (100, 500, 0, 19, 20, 0), 802: (1000, 5000, 0, 0, 20, 300), 803: (100, 500, 300, 0, 20, 0), 804: (100, 5000, 0, 0, 20, 0), 805: (2_000_000, 10_000_000, 0, 0, 20, 0)}
    fine = {901: (100, 500, 0, 1, 2, 0), 902: (100, 500, 0, 1, 20, 0), 903: (100, 500, 0, 0, 1, 9)}
    rows += [(i, "en", "s", *v) for i, v in (odd | fine).items()]
    got = rows_of(quality_rules.judge(spark.createDataFrame(rows, STATS).withColumn("base_failed", F.lit(False))))
    assert not any(got[i]["kept"] for i in odd) and all(got[i]["kept"] for i in fine)
    assert sum(got[i]["kept"] for i in range(800)) >= 798


def test_the_start_of_least_determinant_is_kept(spark):
    """A compact cluster of odd copies holds a quarter of a source, with names that hold separators."""
    rnd = np.random.default_rng(9)
    rows = []
    for i in range(1000):
        w = 400 if i % 4 == 0 else int(np.exp(rnd.normal(5, 0.6))) + 30
        rows.append((i, "en", "s\x01moments", w, int(w * (9.0 if i % 4 == 0 else np.exp(rnd.normal(1.6, 0.06)))), int(w * (0.9 if i % 4 == 0 else 0.001 * rnd.random())), 0, 20, 0))
    df = spark.createDataFrame(rows, STATS).withColumn("base_failed", F.lit(False))
    got, (want, _, det) = rows_of(quality_rules.judge(df)), plain_mcd(vectors(df), quality_rules.HALF, quality_rules.STEPS)
    assert np.allclose([got[i]["distance2"] for i in range(1000)], want, rtol=0.06, atol=0.06)
    assert not any(got[i]["kept"] for i in range(0, 1000, 4)) and np.mean([got[i]["kept"] for i in range(1000) if i % 4]) > 0.99


def test_robust_distances_match_numpy(spark):
    rnd = np.random.default_rng(8)
    n = 1200
    rows = [(i, "en", "s", int(np.exp(rnd.normal(5, 0.7))) + 20, 0, 0, 0, 20, 0) for i in range(n)]
    rows = [(i, a, b, w, int(w * np.exp(rnd.normal(1.6, 0.05))), int(w * (0.8 if i % 10 == 0 else 0.001)), dl, li, 0) for i, a, b, w, _, _, dl, li, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long").withColumn("base_failed", F.lit(False))
    got = rows_of(quality_rules.judge(df))
    x = vectors(df)
    want, _, _ = plain_mcd(x, quality_rules.HALF, quality_rules.STEPS)
    mine = np.array([got[i]["distance2"] for i in range(n)])
    assert np.allclose(mine, want, rtol=0.05, atol=0.05)
    assert not any(got[i]["kept"] for i in range(0, n, 10)) and np.mean([got[i]["kept"] for i in range(n) if i % 10]) > 0.99


def test_sparse_groups_borrow_and_odd_groups_stay(spark, odd):
    stats = quality_rules.statistics(odd, "text", ("doc_id", "lang", "source"))
    assert quality_rules.judge(stats).count() == len(ODD_TEXTS)


@pytest.mark.parametrize("broadcast", [True, False])
def test_borrowed_estimates_hold_all_rows_of_the_wider_group(spark, monkeypatch, broadcast):
    """A hot source beside one of three rows, and a language of three rows; the last row of each is mostly symbols."""
    if not broadcast:
        monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)
    rnd = np.random.default_rng(11)
    groups = [("en", "hot")] * 600 + [("en", "few")] * 3 + [("xx", "rare")] * 3 + [("en", "failed")]
    odd = (602, 605)
    rows = []
    for i, (lang, source) in enumerate(groups):
        w = int(np.exp(rnd.normal(5, 0.5))) + 20
        chars = int(w * np.exp(rnd.normal(1.6, 0.05)))
        rows.append((i, lang, source, w, chars, int(chars * (0.81 if i in odd else 0.002)), 0, 20, 0, source == "failed"))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long, base_failed boolean")
    got = rows_of(quality_rules.judge(df))
    x = vectors(df)
    lang, table = (plain_mcd(x[:n], quality_rules.HALF, quality_rules.STEPS)[0] for n in (603, 606))
    mine = [got[i]["distance2"] for i in range(606)]
    assert np.allclose(mine[600:603], lang[600:603], rtol=0.05, atol=0.05) and np.allclose(mine[603:], table[603:], rtol=0.05, atol=0.05)
    assert [got[i]["kept"] for i in range(600, 606)] == [True, True, False, True, True, False]
    assert len(got) == 607 and not got[606]["kept"] and got[606]["distance2"] is not None


# op10


def test_quality_on_held_out_labels(spark, small_dir):
    d = small_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = rows_of(quality_classifier.classify(docs, labels.where("doc_id % 3 <> 0")))
    held = [(known[k], r["kept"]) for k, r in out.items() if k % 3 == 0 and k in known]
    assert np.mean([y == p for y, p in held]) >= 0.95 and len(out) == docs.count()


def test_quality_evidence_against_brute_force(spark, small_dir):
    """The likelihood ratios, from statistics counted in Python and a fit by plain gradient steps on the same labels."""
    docs, labels = spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/labels.parquet")
    again = labels.unionAll(labels.where("quality = 1").limit(5))   # repeated labels count once
    root = lambda a, b: math.sqrt(a / max(b, 1))

    def measure(t):
        t, w = t or "", re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower())
        lines, count = t.split("\n"), lambda f: sum(map(f, t))
        return [math.log1p(len(w)), root(len(w) - len(set(w)), len(w)), root(sum(a == b for a, b in zip(w, w[1:])), len(w)), root(count(lambda c: c in "#*$%&|<>"), len(t)),
                root(count(str.isupper), len(t)), root(count(lambda c: c in "0123456789"), len(t)), root(count(lambda c: c in "!?"), len(t)), root(len(lines) - len(set(lines)), len(lines))]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    x = {r["doc_id"]: measure(r["text"]) for r in docs.collect()}
    keys = [k for k in x if k in truth]
    data, y = np.array([x[k] for k in keys]), np.array([truth[k] for k in keys], dtype=float)
    mean, scale = data.mean(axis=0), data.std(axis=0) + 1e-6
    z = np.hstack(((data - mean) / scale, np.ones((len(keys), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(60_000):
        w -= 0.01 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + quality_classifier.RIDGE * np.append(w[:-1], 0)) / math.sqrt(len(keys))
    prior = math.log(y.mean() / (1 - y.mean()))
    got = rows_of(quality_classifier.classify(docs, again))
    for k, v in x.items():
        e = float(((np.array(v) - mean) / scale) @ w[:-1] + w[-1] - prior)
        assert got[k]["evidence"] == pytest.approx(max(-quality_classifier.CLIP, min(quality_classifier.CLIP, e)), abs=2e-2)


def test_shrinkage_by_hand(spark):
    """Shares and scores from the evidence column, worked out again in Python."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = rows_of(quality_classifier.classify(docs, labels))
    y = [r["quality"] for r in labels.collect() if r["quality"] is not None]
    prior = min(0.99, max(0.01, sum(y) / len(y)))
    sig = lambda x: 1 / (1 + math.exp(-x))
    good = {k: sig(r["evidence"] + math.log(prior / (1 - prior))) for k, r in out.items()}
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    host, path = defaultdict(list), defaultdict(list)
    for k, g in good.items():
        host[site[k][0]].append(g)
        path[site[k]].append(g)

    def strength(groups):
        groups = [g for g in groups if len(g) >= 2]
        m = np.mean([np.mean(g) for g in groups])
        between = np.var([np.mean(g) for g in groups]) - m * (1 - m) * np.mean([1 / len(g) for g in groups])
        low, high = quality_classifier.STRENGTH
        return min(high, max(low, m * (1 - m) / between - 1 if between > 0 else high))
    overall, a, b = np.mean(list(good.values())), strength(host.values()), strength(path.values())
    for k, r in out.items():
        h = (sum(host[site[k][0]]) + a * overall) / (len(host[site[k][0]]) + a)
        p = path[site[k]]
        rest = (sum(p) - good[k] + b * h) / (len(p) - 1 + b)
        rest = min(0.999, max(0.001, rest))
        assert r["host_share"] == pytest.approx(h) and r["path_share"] == pytest.approx((sum(p) + b * h) / (len(p) + b))
        assert r["score"] == pytest.approx(sig(r["evidence"] + math.log(rest / (1 - rest))))

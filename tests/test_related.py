"""Related items (SEA-06) against a brute-force reference on random keyword
sets, covering both candidate paths (subsets of few keywords, prefixes of
many)."""

import random

import pytest

from quillspark.operators import related as R
from quillspark.operators.related import related


def _brute(items, threshold, k):
    out = {}
    for i, ki in items.items():
        own = sum(ki.values())
        scored = []
        for j, kj in items.items():
            if i == j:
                continue
            shared = sum(w for kw, w in ki.items() if kw in kj)
            sc = 100.0 * shared / own
            if sc >= threshold:
                scored.append((-sc, j))
        scored.sort()
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.mark.parametrize("seed,threshold,most", [(1, 80.0, 5), (2, 50.0, 5), (3, 30.0, 5), (4, 80.0, 40), (5, 60.0, 25)])
def test_related_matches_brute_force(spark, seed, threshold, most):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]  # the first three are in most items
    weights = {"tags": 80, "categories": 70, "authors": 20}
    items, rows = {}, []
    for i in range(120):
        kws = {}
        for _ in range(rnd.randint(1, most)):
            idx = rnd.choice(list(weights))
            kws[(idx, rnd.choice(vocab[: rnd.choice([3, 12])]))] = weights[idx]
        items[i] = kws
        rows += [(i, idx, kw, w) for (idx, kw), w in kws.items()]
    kw_df = spark.createDataFrame(rows, "id long, index string, keyword string, weight int")
    got = {}
    for r in related("id", kw_df, threshold=threshold, k=5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["related_id"], r["score"]))
    got = {i: [(j, s) for _, j, s in sorted(v)] for i, v in got.items()}
    exp = {i: v for i, v in _brute(items, threshold, 5).items() if v}
    assert got.keys() == exp.keys()
    for i in exp:
        assert [j for j, _ in got[i]] == [j for j, _ in exp[i]]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got[i], exp[i]))


def _as_dict(rows, key="id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append((r["rank"], r["related_id"], r["score"]))
    return {i: [(j, s) for _, j, s in sorted(v)] for i, v in out.items()}


def _frame(spark, items):
    return spark.createDataFrame([(i, idx, kw, w) for i, ks in items.items() for (idx, kw), w in ks.items()], "id long, index string, keyword string, weight int")


@pytest.mark.parametrize("n", [300, 1200])
def test_a_keyword_on_every_item_makes_few_candidates(spark, n):
    """All items share a tag that alone reaches the threshold: all pairs are related, each item meets at most
    2 * (k + 1) signatures."""
    items = {i: {("tags", "common"): 80, ("authors", f"a{i}"): 20} for i in range(n)}
    kw = _frame(spark, items)
    sigs, _ = R.signatures(R.numbered(kw, "id"), 5)
    assert R._by_subsets(sigs, 0.8, 5).count() <= n * 2 * 6
    got = _as_dict(related("id", kw).collect())
    assert all(got[i] == [(j, 80.0) for j in [j for j in range(7) if j != i][:5]] for i in items)


def test_null_and_empty_keywords_relate_nothing(spark):
    rows = [(i, "tags", None, 80) for i in range(4)] + [(i, "categories", "", 70) for i in range(4)] + [(9, None, "x", 5), (10, None, "x", 5), (None, "tags", "t", 80),
            (20, "tags", "T", 80), (21, "tags", "t", 80), (21, "tags", "T", 10), (22, "authors", "t", 80)]
    got = related("id", spark.createDataFrame(rows, "id long, index string, keyword string, weight int")).collect()
    assert sorted((r["id"], r["related_id"], r["score"]) for r in got) == [(20, 21, 100.0), (21, 20, 100.0)]


@pytest.mark.parametrize("seed,few,hot", [(11, 3, 5), (12, 8, 20), (13, 1, 3)])
def test_hot_keywords_are_dealt(spark, monkeypatch, seed, few, hot):
    """Groups of near copies with many shared keywords, and lists longer than a share."""
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "HOT", hot)
    rnd = random.Random(seed)
    base = [[("title", f"t{rnd.randrange(40)}") for _ in range(9)] + [("tags", f"g{rnd.randrange(3)}")] for _ in range(8)]
    items = {}
    for i in range(160):
        ks = dict.fromkeys(rnd.choice(base)[: rnd.randint(1, 10)])
        if rnd.random() < 0.7:
            ks[("summary", f"own{i if rnd.random() < 0.5 else i % 9}")] = None
        items[i] = {k: {"title": 60, "tags": 80, "summary": 50}[k[0]] for k in ks}
    want = {i: [(j, s) for j, s in v] for i, v in _brute(items, 80.0, 5).items() if v}
    got = _as_dict(related("id", _frame(spark, items)).collect())
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[i], want[i]))


def test_no_table_of_a_row_a_keyword_goes_through_the_driver(spark):
    """Files of sets are small for the rows that they become, so no join may be planned by their size."""
    items = {i: {("title", f"t{(i * 7 + j) % 60}"): 60 for j in range(2 + i % 20)} | {("tags", f"g{i % 3}"): 80} for i in range(200)}
    sigs, _ = R.signatures(R.numbered(_frame(spark, items), "id"), 5)
    for df in (R._by_subsets(sigs, 0.8, 5), R._by_prefix(sigs, 0.8)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    want = {i: [(j, s) for j, s in v] for i, v in _brute(items, 80.0, 5).items() if v}
    got = _as_dict(related("id", _frame(spark, items)).collect())
    assert got.keys() == want.keys() and all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want)


def _copies(n, words=19, own=1):
    """Items that share all but ``own`` of their keywords."""
    return {i: {("title", f"w{j}"): 60 for j in range(words)} | {("title", f"own{i}-{j}"): 60 for j in range(own)} for i in range(n)}


def test_near_copies_are_scored_a_few_times_an_item(spark):
    """All pairs of items are near copies that score the same; each is scored on the whole sets with a few others."""
    items = _copies(100)
    sigs, _ = R.signatures(R.numbered(_frame(spark, items), "id"), 5)
    assert R._by_prefix(sigs, 0.8, 5).count() <= 100 * R.TRIED * 5
    got = _as_dict(related("id", _frame(spark, items)).collect())
    assert all([j for j, _ in got[i]] == [j for j in range(6) if j != i][:5] for i in items)


def test_unrelated_items_with_a_common_prefix_do_not_meet(spark):
    """Every item has three words of all items and up to twelve that a few others have: prefixes share words, nothing is near."""
    rnd = random.Random(7)
    items = {}
    for i in range(120):
        items[i] = {("title", f"c{j}"): 60 for j in range(3)} | {("summary", f"s{rnd.randrange(60)}"): 50 for _ in range(12)}
    sigs, _ = R.signatures(R.numbered(_frame(spark, items), "id"), 5)
    assert R._met(sigs, 0.8).count() <= len(items)
    want = {i: [(j, s) for j, s in v] for i, v in _brute(items, 80.0, 5).items() if v}
    got = _as_dict(related("id", _frame(spark, items)).collect())
    assert got.keys() == want.keys() and all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want)


@pytest.mark.parametrize("seed,tried,wide,words,k", [(21, 1, 128, 4, 3), (22, 1, 2, 1, 5), (23, 2, 4, 2, 1), (24, 3, 128, 1, 5)])
def test_best_of_many_near_copies(spark, monkeypatch, seed, tried, wide, words, k):
    """More near copies than are tried at first, with ties, unequal weights, full sketches and sets of very unequal size."""
    monkeypatch.setattr(R, "TRIED", tried)
    monkeypatch.setattr(R, "WIDE", wide)
    monkeypatch.setattr(R, "WORDS", words)
    rnd = random.Random(seed)
    weights = {"title": 60, "summary": 50, "tags": 80, "authors": 20, "notes": 0.7}
    names = list(weights)
    base = [[(rnd.choice(names), f"b{b}-{j}") for j in range(rnd.randint(12, 40))] for b in range(4)]
    items = {}
    for i in range(160):
        ks = dict.fromkeys(rnd.choice(base))
        for x in rnd.sample(list(ks), rnd.randint(0, 4)):
            del ks[x]
        for _ in range(rnd.randint(0, 4)):
            ks[(rnd.choice(names), f"more{rnd.randrange(30)}")] = None
        if rnd.random() < 0.05:
            ks |= dict.fromkeys((rnd.choice(names), f"more{j}") for j in range(150))
        items[i] = {x: weights[x[0]] for x in ks}
    want = {i: v for i, v in _brute(items, 80.0, k).items() if v}
    rows = [(i, idx, kw, float(w)) for i, ks in items.items() for (idx, kw), w in ks.items()]
    got = _as_dict(related("id", spark.createDataFrame(rows, "id long, index string, keyword string, weight double"), k=k).collect())
    assert got.keys() == want.keys()
    for i in want:  # sums of 0.7 differ in the last digits, so that ties may be in another order there
        assert [round(s, 6) for _, s in got[i]] == [round(s, 6) for _, s in want[i]]
        assert all(abs(s - _of(items, i, j)) < 1e-9 for j, s in got[i])


def _of(items, i, j):
    return 100.0 * sum(w for x, w in items[i].items() if x in items[j]) / sum(items[i].values())

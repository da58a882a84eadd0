"""Text helpers, slug goldens, boolean query compiler and hit spans."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import arrays as AR
from quillspark.functions import boolquery as BQ
from quillspark.functions import text as T


def _one(spark, col, *vals, schema="x string"):
    df = spark.createDataFrame([(v,) for v in vals], schema)
    return [r[0] for r in df.select(col).collect()]


def test_slug_goldens(spark):
    # Goldens read from the generated site: emphasis marks dropped, '#' kept,
    # '&' and ';' dropped, case folded.
    got = _one(spark, T.slug(F.col("x")), "**First M Last**", "&#381;iga Malek",
               "Virtual Reality experiment", "Virtual reality experiment", "Élan Vital")
    assert got == ["first-m-last", "#381iga-malek", "virtual-reality-experiment",
                   "virtual-reality-experiment", "elan-vital"]


def test_fold_table_aligned():
    assert len(T.ACCENTED) == len(T.FOLDED)
    assert "é" in T.ACCENTED and T.FOLDED[T.ACCENTED.index("é")] == "e"


def test_truncate_word_break(spark):
    got = _one(spark, T.truncate(F.col("x"), 10), "short", "hello wonderful world", "abcdefghijklmno")
    assert got == ["short", "hello…", "abcdefghij…"]


def test_replace_first_only(spark):
    assert _one(spark, T.replace_first(F.col("x"), "a", "A"), "banana", "xyz") == ["bAnana", "xyz"]


def test_strip_html(spark):
    html = "<html><script>var a='<p>';</script><style>p{}</style><p>Tom &amp; Jerry&nbsp;<b>run</b></p></html>"
    assert _one(spark, T.strip_html(F.col("x")), html) == ["Tom & Jerry run"]


def test_address_skips_empty(spark):
    df = spark.createDataFrame([("1 Main", "", "CA", "9")], "s string, c string, r string, p string")
    a = T.assemble({"street": F.col("s"), "city": F.col("c"), "region": F.col("r"), "postcode": F.col("p")},
                   ["street", "city", "region", "postcode"], [", ", ", ", " ", ""])
    assert df.select(a).first()[0] == "1 Main, CA 9"


WORDS = st.sampled_from(["the", "la", "und", "cat", "dog", "@ann", "@bob", "x"])


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(WORDS, min_size=0, max_size=6).map(" ".join), min_size=1, max_size=8),
       query=st.sampled_from(["the", "the OR la", "cat -dog", "(cat OR dog) und", "to:ann", "-to:ann",
                              "cat NOT dog", '"the la"', "((broken", "to:bob OR la"]))
def test_boolquery_matches_direct_evaluator(spark, texts, query):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(BQ.compile_query("x", query)).collect()]
    assert got == [BQ.evaluate(t, query) for t in texts]


def test_to_field_never_matches_plain_text():
    assert BQ.evaluate("hello ann", "-to:ann") is False
    assert BQ.evaluate("@ann @bob hi", "to:bob") is True
    assert BQ.evaluate("@ann hi @bob", "to:bob") is False


def _brute_spans(text, terms):
    spans = []
    for t in terms:
        spans += [(m.start(), m.start() + len(t) - 1) for m in re.finditer(re.escape(t), text, re.I)]
    spans.sort()
    out = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@settings(max_examples=40, deadline=None)
@given(text=st.text(alphabet="the xTHE", max_size=40))
def test_merged_spans_vs_brute_force(spark, text):
    df = spark.createDataFrame([(text,)], "x string")
    col = AR.merge_spans(F.concat(AR.hit_spans(F.col("x"), "the"), AR.hit_spans(F.col("x"), "he ")))
    got = [(r["start"], r["end"]) for r in df.select(col).first()[0]]
    assert got == _brute_spans(text, ["the", "he "])

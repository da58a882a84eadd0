"""The pipeline, stage by stage, against plain Python over the smallest table."""

import hashlib
import os
import sys

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from quillspark import session  # noqa: E402
from quillspark.llm import bpe, mixing, queries, secret_scan, toxicity  # noqa: E402
from test_llm_operators import frame, plain_components, plain_markov, plain_mix, plain_rules, plain_simhash  # noqa: E402


def test_stages_against_plain_python(spark, small_dir):
    import tiktoken
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = toxicity.train(docs, labels)
    rows = [r for r in rows if toxicity.score_text(r["text"], model, {})[0] < corpus_pipeline.TOXIC]
    group = plain_components({r["doc_id"]: plain_simhash(r["text"]) for r in rows}, corpus_pipeline.DISTANCE)
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    kept = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    chars = secret_scan.train(kept)
    for r in rows:
        rules = plain_rules(r["text"])
        spans, at, out = sorted(rules + plain_markov(r["text"], chars, rules)), 0, ""
        for a, _, b in spans:
            if a >= at:
                out += r["text"][at:a] + "[SECRET]"
            at = max(at, b)
        r["text"] = out + r["text"][at:] if spans else r["text"]
    domains = {r["source"]: r["d"] for r in docs.select("source", mixing.domain_of(F.col("source")).alias("d")).distinct().collect()}
    named = [r | {"domain": domains[r["source"]], "tokens": len(r["text"].split())} for r in rows]
    taken, _ = plain_mix(named, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS, corpus_pipeline.SEED)
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r["doc_id"]: (np.array(library.encode_ordinary(r["text"]), dtype="<u4").tobytes(), r["text"]) for r in rows if (r["doc_id"], 0) in taken}
    before = len(session._SCRATCH)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small_dir).collect()}
    assert set(got) == set(want) and len(session._SCRATCH) == before + 1   # the last stage's input alone is left
    for k, (ids, text) in want.items():
        assert bytes(got[k]["ids"]) == ids and got[k]["n_tokens"] == len(ids) // 4
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_and_odd_rows(spark, small_dir, tmp_path):
    texts = [None, "", "one two three four five", "one two three four five", "x" * 3000, "token=" + "0a1b" * 6]
    odd = frame(spark, texts)
    for docs in (odd, frame(spark, [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small_dir)
            assert docs.columns == odd.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir)
        assert docs.count() >= 0


def test_stages_leave_columns_of_any_name_alone(spark, small_dir):
    """Columns named like those that operators add or use inside keep their values."""
    names = ["toxicity", "offending", "spans", "base_spans", "__markov", "row", "fp", "__fp", "component", "root", "__text", "blotted", "tokens", "epoch", "a.b", "__key", "__least"]
    texts = ["one two three four five", "one two three four five", "token=" + "0a1b" * 6, None, "", "some other words stand here now"]
    rows = [(i, t, "en", "src1", len(t or "")) + tuple(f"{n}-{i}" for n in names) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir)
        assert docs.columns == columns, name
        kept = docs.collect()
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in kept for n in names), name
        docs = spark.createDataFrame(kept, docs.schema)
        if name == "near_duplicates":
            assert {0, 2} <= {r["doc_id"] for r in kept} and 1 not in {r["doc_id"] for r in kept}
        if name == "secrets":
            assert {r["text"]: r["n_chars"] for r in kept}["[SECRET]"] == 8

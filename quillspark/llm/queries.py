"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quillspark.llm import ann, bpe, importance, language, lexical, licences, mixing, quality_classifier, quality_rules, secret_scan, sharding, simhash, toxicity
from quillspark.llm.common import read

RANKS = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = sharding.shard_table(docs, "doc_id", "text", sharding.layout(16), sharding.layout(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.broadcast_vocabulary(spark, public_tokenizers.path(RANKS))
    ids = bpe.encode(docs, "text", vocabulary, public_tokenizers.PATTERN, carry=["doc_id"])
    back = bpe.decode(ids, "ids", vocabulary)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op3_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@register
def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.train(docs))
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text("base_spans"), 256).alias("base_sha256"), secret_scan.spans_text("spans").alias("spans"))


@register
def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.train(docs, labels.where(~held_out), "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "offending")


#: Target weights of the query's mix: domains and languages by name, any other name 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def _deal_sql(number: int, parent: list[str], name: str, weights: dict[str, int], epochs: int) -> str:
    """One level of the budget's descent, as three common table expressions."""
    keys, by = ", ".join([*parent, name]), f"PARTITION BY {', '.join(parent)} " if parent else ""
    weight = f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END" if weights else "1"
    given = f"JOIN b{number - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN b0"
    order = f"{by}ORDER BY CAST(cap AS DOUBLE) / weight, {name}"
    return f"""
n{number} AS (SELECT s.*, budget AS given FROM (SELECT {keys}, CAST(sum(tokens) * {epochs} AS DOUBLE) AS cap, {weight} AS weight FROM leaves GROUP BY {keys}) s {given}),
l{number} AS (SELECT *, (given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM n{number}),
b{number} AS (SELECT {keys}, greatest(coalesce(least(cap, first_value(CASE WHEN cap > level * weight THEN level END IGNORE NULLS)
                OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight), cap), 0.0) AS budget FROM l{number})"""


MIX = {"share": 0.8, "epochs": 3, "seed": 20}
ORACLE["op6_tree_mix"] = f"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, 'd' || CAST((strpos('0123456789abcdef', md5(coalesce(source, ''))[1]) - 1) % 4 AS VARCHAR) AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT floor(CAST(sum(tokens) AS DOUBLE) * {MIX['share']}) AS budget FROM leaves),
{_deal_sql(1, [], 'domain', WEIGHTS['domain'], MIX['epochs'])}, {_deal_sql(2, ['domain'], 'lang', WEIGHTS['lang'], MIX['epochs'])},
{_deal_sql(3, ['domain', 'lang'], 'source', {}, MIX['epochs'])},
ends AS (SELECT *, budget - whole * tokens AS rest FROM (
    SELECT l.*, b3.budget, CAST(CASE WHEN tokens > 0 THEN floor(budget / CAST(tokens AS DOUBLE)) ELSE 0 END AS INTEGER) AS whole
    FROM leaves l JOIN b3 USING (domain, lang, source))),
k AS (SELECT d.*, e.budget, e.whole, e.rest, coalesce(sum(d.tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{MIX['seed']}:' || CAST(e.whole AS VARCHAR) || ':' || d.id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN ends e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(unnest(range(whole + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch,
       budget AS leaf_budget FROM k"""


@register
def op6_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    slim = docs.select("doc_id", "lang", "source", mixing.whitespace_tokens(F.col("text")).alias("tokens"))
    taken = mixing.mix(slim, mixing.domain_of(F.col("source")), F.col("tokens"), WEIGHTS, **MIX)
    return taken.select("row.doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "epoch", F.col("budget").alias("leaf_budget"))


@register
def op7_rare_word_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.Index(*licences.frequencies(docs)), carry=["doc_id"]).select("doc_id", "licence.*")
    starts = F.transform("base", lambda b: b["start"])
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.transform("labels", lambda x: x["label"])), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("labels", lambda x: x["score"])), F.lit(0.0)).alias("score"))


@register
def op8_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, "vec_id", "embedding", k=10)


@register
def op9_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    stats = quality_rules.statistics(docs, "text", ("doc_id", "lang", "source"))
    judged = quality_rules.judge(stats)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@register
def op10_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE["op11_limited_accumulators"] = f"""
WITH words AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
               FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tfs AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY row),
whole AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, row, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
                    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms)))) AS BIGINT) AS score
           FROM wanted JOIN tfs USING (term) JOIN dfs USING (term) JOIN sizes USING (row) CROSS JOIN whole GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


@register
def op11_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


@register
def op12_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language.train(docs.where(~held_out))
    found = language.predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


RESAMPLE = {"buckets": 10_000, "runs": 1, "percent": 10, "least": 20, "seed": 2024}
#: CRC-32 of a word's bytes: a table of 256 entries made by the polynomial's rule, then a fold over the bytes.
_CRC = """CAST(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(hex(encode(term))) // 2), lambda i: ('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
            lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT) AS BIGINT)"""
ORACLE["op13_bit_sliced_importance"] = f"""
WITH crcs AS (SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_concat([CAST(n AS BIGINT)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
words AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
          FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tfs AS (SELECT row, term, count(*) AS tf FROM words GROUP BY ALL),
goals AS (SELECT term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY term),
hashed AS (SELECT term, {_CRC} % {RESAMPLE['buckets']} AS bucket FROM (SELECT term FROM tfs UNION SELECT term FROM goals), crcs),
s AS (SELECT bucket, sum(tf) AS s FROM tfs JOIN hashed USING (term) GROUP BY bucket),
t AS (SELECT bucket, sum(tf) AS t FROM goals JOIN hashed USING (term) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST((SELECT sum(s) FROM s) AS DOUBLE) + {RESAMPLE['buckets']})
            / ((CAST(s AS DOUBLE) + 1) * (CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) + {RESAMPLE['buckets']})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n_features, CAST(sum(tf * gain) AS BIGINT) AS weight FROM tfs JOIN hashed USING (term) JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
             (CAST(('0x' || substr(sha256('{RESAMPLE['seed']}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
           FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN weighed USING (row)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {RESAMPLE['least']} ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {RESAMPLE['least']} AND place <= (SELECT count(*) FROM scored WHERE n_features >= {RESAMPLE['least']}) * {RESAMPLE['percent']} // 100
         THEN place END AS rank FROM ranked"""


@register
def op13_bit_sliced_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), **RESAMPLE)

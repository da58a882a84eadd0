"""Secret scans: fixed rules plus a log-likelihood ratio of two character Markov models.

Rules (``assign``, ``access``, ``hex``) find spans by pattern. The method adds spans of kind ``markov``: runs of 16 or
more of ``A-Za-z0-9+/_=-`` whose characters follow a model of random strings better than a model of ordinary
identifiers, by ``margin`` nats or more in all and ``rate`` nats a character or more. Both models are first-order
(counts of character pairs with smoothing). They are trained from labelled samples of the table itself: the values the
rules found are the random strings, the other runs of 6 or more are the ordinary identifiers. Samples are bounded by
``SECRET_DOCS`` and ``PLAIN_DOCS`` documents, chosen by a hash of the id; the scan itself covers every whole text.
Without any labelled secret the random model is uniform, which smoothing alone gives.

Everything is a DataFrame expression. A span's place comes from the lengths of the pieces between the matches.
Offsets count code points, the end is exclusive. A null text counts as empty and has no spans. A markov span is left
out only where rules' spans cover all of it; else it stays beside those it overlaps. Rule spans always stay. Spans that begin
at the same place come by kind. Whole texts are scanned, however long: a run is split to characters once, and what depends on
earlier spans comes from running sums and maxima, so a text of a megabyte without a break or of 100,000 spans takes seconds.
Repeated rows are scanned alike. Columns ``base_spans``, ``spans`` and ``__markov`` of the input are replaced. An empty table
gives no rows, and a model of smoothing alone.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_sample, let, prefix_maxima, prefix_sums, text_of

# The rules' patterns and lengths, as the contract states them.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_VALUE = 12

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
RUN_CHARS, PLAIN_CHARS = 16, 6
SECRET_DOCS, PLAIN_DOCS = 50_000, 2_000
MARGIN, RATE = 12.0, 0.6

SPAN = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``keep`` holds."""
    def place(matches):
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: g + F.char_length(m))
        found = F.zip_with(prefix_sums(steps), matches, lambda end, m: F.struct(
            (end - F.char_length(m)).cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), m.alias("m")))
        found = found if keep is None else F.filter(found, lambda s: keep(s["m"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), let(matches, place)).otherwise(F.array().cast(SPAN))


def rule_spans(text: Column) -> Column:
    """The rules' spans by start, then kind as listed."""
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    return F.sort_array(F.concat(_spans(text, ASSIGN, 0, value), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", secret_docs: int = SECRET_DOCS, plain_docs: int = PLAIN_DOCS) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each character after each other one, row by row of
    ``ALPHABET``. Fitted on bounded samples; only the pair counts (2 x 67 x 67 at most) come to the driver."""
    texts = docs.select(text_of(text).alias("__t"), F.col(key).alias("__h"))
    total = docs.count()
    values = (hash_sample(texts, "__h", secret_docs, total, 41)
              .select(F.explode(F.concat(
                  F.filter(F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= ASSIGN_VALUE),
                  F.regexp_extract_all("__t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("__t", F.lit(HEX), F.lit(0)))).alias("run"))
              .select(F.lit(1).alias("secret"), "run"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("__t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = (hash_sample(texts, "__h", plain_docs, total, 43)
             .select(F.explode(F.regexp_extract_all(clean, F.lit(RUN % PLAIN_CHARS), F.lit(0))).alias("run"))
             .select(F.lit(0).alias("secret"), "run"))
    pairs = (values.unionAll(plain).groupBy("secret", "run").agg(F.count("*").alias("n")).where(F.char_length("run") > 1)
             .select("secret", "n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - 1),
                                                          lambda i: F.substring("run", i, F.lit(2)))).alias("pair"))
             .groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect())
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[1.0] * k for _ in range(k)] for _ in range(2)]
    for r in pairs:
        if r["pair"][0] in at and r["pair"][1] in at:
            counts[r["secret"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["n"]
    log = [[[math.log(c / sum(row)) for c in row] for row in kind] for kind in counts]
    return [log[1][a][b] - log[0][a][b] for a in range(k) for b in range(k)]


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a run: the sum over its character pairs, by place in the model's table. The run is split to
    characters once, and each is looked up once."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(let(places, pairs), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def markov_spans(text: Column, model: list[float], margin: float = MARGIN, rate: float = RATE) -> Column:
    def random(m):
        return let(ratio(m, model), lambda score: (score >= margin) & (score >= F.char_length(m) * F.lit(rate)))
    return _spans(text, RUN % RUN_CHARS, 3, random)


def scan(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """Adds ``base_spans`` (the rules') and ``spans`` (all), arrays of (start, rank, end) by start, then kind; ``rank``
    is the kind's place in ``KINDS``."""
    doc = text_of(text)
    out = docs.withColumns({"base_spans": rule_spans(doc), "__markov": markov_spans(doc, model)})
    both = F.when((F.size("__markov") > 0) & (F.size("base_spans") > 0), _not_covered(F.sort_array(F.concat("base_spans", "__markov")))) \
            .otherwise(F.concat("base_spans", "__markov"))
    return out.withColumn("spans", both).drop("__markov")


def _last_first(values: Column) -> Column:
    """The array in reverse, as numbers whose running maximum is the running minimum from the end."""
    return F.transform(F.reverse(values), lambda x: F.lit(1 << 40) - x)


def _not_covered(spans: Column) -> Column:
    """``spans`` (by start, then rank) without the markov spans that rules' spans cover wholly, together or alone. The rules'
    spans make islands where each begins at or before the furthest end so far; a markov span is covered if it begins inside
    an island and the island ends no sooner. Ends so far come from running maxima, an island's end from the next island's
    beginning, found by running minima from the right: the cost does not grow with the pairs of spans."""
    markov = KINDS.index("markov")
    far = 1 << 40

    def judge(s):
        ends = F.transform(s, lambda x: F.when(x["rank"] == markov, 0).otherwise(x["end"]).cast("long"))

        def by_ends(reach):
            # where a rule's span begins beyond all before it, the reach before it is the end of an island
            marks = F.transform(s, lambda x, i: F.when((x["rank"] != markov) & (i > 0) & (x["start"] > F.coalesce(F.get(reach, i - 1), F.lit(0))), F.get(reach, i - 1))
                                .otherwise(F.lit(far)).cast("long"))
            def by_marks(left):
                island = lambda i: F.least(F.coalesce(F.lit(far) - F.get(left, F.size(left) - 2 - i), F.lit(far)), F.element_at(reach, -1))
                covered = lambda x, i: (x["rank"] == markov) & (F.get(reach, i) > x["start"]) & (island(i) >= x["end"])
                return F.transform(s, lambda x, i: F.struct(x.alias("span"), (~covered(x, i)).alias("keep")))
            return F.transform(F.filter(let(prefix_maxima(_last_first(marks)), by_marks), lambda y: y["keep"]), lambda y: y["span"])
        return let(prefix_maxima(ends), by_ends)
    return let(spans, judge)


def spans_text(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: str, mark: str = "[SECRET]", chunk: int = 4096) -> Column:
    """The text with each stretch that spans cover replaced by ``mark`` (spans that overlap become one stretch). The text is
    cut to chunks once; a stretch is taken from the chunks it lies in, so the cost does not grow with spans times length."""
    def between(chunks, a, b):
        first = F.floor(a / F.lit(chunk)).cast("int")
        part = lambda k: F.substring(F.get(chunks, k), F.greatest(a - k * chunk, F.lit(0)) + 1, b - F.greatest(a, k * chunk))
        return F.when(b > a, F.array_join(F.transform(F.sequence(first, F.floor((b - 1) / F.lit(chunk)).cast("int")), part), "")).otherwise(F.lit(""))

    def pieces(s, reach, chunks):
        before = F.transform(s, lambda x, i: F.struct(F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0)).cast("int").alias("at"), x["start"].alias("start")))
        fresh = F.filter(before, lambda x: x["start"] >= x["at"])
        kept = F.transform(fresh, lambda x: F.concat(between(chunks, x["at"], x["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(chunks, F.element_at(reach, -1).cast("int"), F.char_length(text)))
    ends = F.transform(spans, lambda x: x["end"].cast("long"))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(F.sort_array(spans), lambda s: let(prefix_maxima(ends), lambda reach: let(cut, lambda chunks: pieces(s, reach, chunks))))).otherwise(text)

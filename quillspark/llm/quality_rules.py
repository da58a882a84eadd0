"""Quality rules: fixed limits plus robust multivariate outliers per language and source.

Each text gives five statistics, each put on a scale on which ordinary prose is roughly bell-shaped (``FEATURES``).
For every (language, source) a minimum-covariance-determinant estimate of centre and covariance is found from several
starts (``STARTS``: medians with quartiles, means with covariances, and the covariance of directions from the median) by
concentration: take the half of the documents nearest by Mahalanobis distance, then repeatedly the mean and covariance of
the ``HALF`` nearest. After ``STEPS`` steps each group keeps the start of least determinant, and goes on until its determinant
falls by less than ``SETTLED`` (in logarithm) or ``MOST_STEPS`` more are done; a step that does not lower it is not taken. A
document is rejected if its squared distance is above the chi-squared ``LEVEL`` quantile. Groups under ``LEAST`` documents use their language's estimate, and
languages under ``LEAST`` the whole table's, each made from all good documents of the language or table, those of large
groups too; a variance floor (``FLOOR``) keeps the covariance regular where a
statistic hardly varies.

Only DataFrame expressions: covariances are grouped sums, the nearest half is a grouped approximate percentile, the
distance is a Cholesky solve written out in columns. Texts are read once; all later steps read a narrow table.

Rules for odd rows: a null text has no words (and fails); null language or source are groups of their own; repeated
rows are judged alike; an empty table gives no rows; extra columns are not read; whole texts are read, however long (a text's words are
held once as an array); distances equal to the limit are kept.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, let, small_side, text_of, written

# The base rule of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS, WINDOW, REPEAT_SHARE = 20, 8, (100, 30)

FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
#: Standard deviations that are added to each statistic's own, squared: differences below these never count as odd. With them
#: repeated lines alone reject a text from about 0.82 of its lines on (one boilerplate line of two does not), and repeated words
#: from about 0.29 of its words on (the base rule fails it beyond 0.3).
FLOOR = (0.25, 0.06, 0.03, 0.16, 0.095)
HALF, LEVEL, STEPS, LEAST = 0.75, 0.99999, 2, 200
STARTS, MOST_STEPS, SETTLED = ("quartiles", "moments", "directions"), 6, 0.01
#: Shares into which a group's rows are dealt where the estimates are too many for a broadcast.
SALTS = 32


def _windows(words: Column) -> Column:
    """A 64-bit hash for each window of 8 words, built by doubling: of two words, of four, of eight."""
    def pairs(a, k):
        n = F.greatest(F.size(a) - k, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(1 + k), n), lambda x, y: F.xxhash64(x, y))
    return let(F.transform(words, lambda w: F.xxhash64(w)),
               lambda one: let(pairs(one, 1), lambda two: let(pairs(two, 2), lambda four: pairs(four, 4))))


def _covered(windows: Column) -> Column:
    """Words under windows that repeat. Sorted by hash, a window with an equal neighbour repeats; their starts in
    order then cover 8 words each, or as many as lie before the next start."""
    def starts(at):
        n = F.size(at)
        h = lambda i: F.get(at, i)["h"]
        same = lambda i: F.coalesce(h(i) == h(i - 1), F.lit(False)) | F.coalesce(h(i) == h(i + 1), F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), n - 1), same), lambda i: F.get(at, i)["i"]))
    cover = lambda s: F.aggregate(
        F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.lit(1 << 30))), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0), lambda t, x: t + x)
    tagged = F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.sort_array(tagged), lambda at: let(starts(at), cover))


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that occur twice or more. Most texts have none, which one hash set shows; only the
    others sort their windows."""
    return let(_windows(words), lambda w: F.when(F.size(w) > F.size(F.array_distinct(w)), _covered(w)).otherwise(0))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, the base statistics and ``base_failed`` of each text."""
    doc = text_of(text)

    def of_words(w):
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        _repeat_words(w).cast("long").alias("n_repeat_words"))
    lines = F.filter(F.split(doc, "\n", -1), lambda s: F.regexp_like(s, F.lit(WORD)))
    of_lines = lambda s: F.struct((F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"), F.size(s).cast("long").alias("n_lines"))
    out = docs.select(
        *keep, let(F.regexp_extract_all(doc, F.lit(WORD), F.lit(0)), of_words).alias("__w"), let(lines, of_lines).alias("__l"),
        F.char_length(F.regexp_replace(doc, SYMBOLS, "")).cast("long").alias("n_symbols")).select(*keep, "__w.*", "__l.*", "n_symbols")
    many, most = REPEAT_SHARE
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (many * F.col("n_repeat_words") > most * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    """Adds ``FEATURES``: log length, log mean word length, and square roots of the shares of symbols, repeated lines
    and repeated words. A text without words has zeros."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = (F.log1p("n_words"), F.ln(chars / n), F.sqrt(F.col("n_symbols") / chars),
              F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n))
    return stats.withColumns({k: v.cast("double") for k, v in zip(FEATURES, values)})


def chi2_quantile(level: float, d: float) -> float:
    """Chi-squared quantile, by Wilson and Hilferty's cube-root approximation."""
    z = NormalDist().inv_cdf(level)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def _chi2_cdf(x: float, d: float) -> float:
    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def _moments(near: DataFrame, factor: float) -> DataFrame:
    """Centre and Cholesky factor of the covariance of each group's rows; ``factor`` makes the covariance of the
    nearest share consistent for a normal distribution."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    agg = near.groupBy("__g").agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
                                  *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs])
    for i, j in pairs:  # Cholesky, row by row; each entry is a column of its own
        cov = F.col(f"c{i}_{j}") * F.lit(factor) + F.lit(FLOOR[i] ** 2 if i == j else 0.0)
        for k in range(j):
            cov = cov - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        floor = F.lit(FLOOR[i] ** 2 / 4)
        agg = agg.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(cov, floor)) if i == j else cov / F.col(f"l{j}_{j}"))
    log_det = sum((F.lit(2.0) * F.ln(f"l{i}_{i}") for i in range(1, d)), F.lit(2.0) * F.ln("l0_0"))
    return agg.select("__g", *[f"m{i}" for i in range(d)], *[f"l{i}_{j}" for i, j in pairs], log_det.alias("__det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    solved: list[Column] = []
    for i, f in enumerate(FEATURES):
        y = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}_{j}") * solved[j]
        solved.append(y / F.col(f"l{i}_{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _beside(rows: DataFrame, side: DataFrame, count: int, row_bytes: int, how: str = "inner") -> DataFrame:
    """Rows with their group's row of ``side`` (``count`` groups). A side too large for a broadcast is repeated for each
    salt, so that a language or table of many rows is not one task's."""
    if count * row_bytes <= BROADCAST_BYTES:
        return rows.join(small_side(side, count, row_bytes), "__g", how)
    return rows.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__g", "__salt"], how)


def _starts(good: DataFrame, mid: DataFrame, models: int) -> list[DataFrame]:
    """The estimates that concentration starts from, in the order of ``STARTS``. ``mid`` has the medians and quartiles. The
    directions are the rows' standardised differences from the median, each scaled to one length, so that no far row counts
    for more than its direction."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    spread = [F.greatest((F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) / F.lit(1.349), F.lit(FLOOR[i])) for i in range(d)]
    quartiles = mid.select("__g", *[f"m{i}" for i in range(d)], *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i, j in pairs],
                           F.lit(0.0).alias("__det"))
    away = [(F.col(f) - F.col(f"m{i}")) / spread[i] for i, f in enumerate(FEATURES)]
    length = F.sqrt(sum((z * z for z in away[1:]), away[0] * away[0]))
    turned = [F.when(F.col("__len") > 0, F.col(f"m{i}") + spread[i] * away[i] * F.lit(math.sqrt(d)) / F.col("__len")).otherwise(F.col(f"m{i}")).alias(f)
              for i, f in enumerate(FEATURES)]
    directions = _beside(good, mid, models, 1024).withColumn("__len", length).select("__g", "__salt", *turned)
    return [quartiles, _moments(good, 1.0), _moments(directions, 1.0)]


def _concentrated(good: DataFrame, model: DataFrame, models: int, share: float) -> DataFrame:
    """One step: the estimate of the ``share`` of each group's rows that are nearest by ``model``."""
    d = float(len(FEATURES))
    far = _beside(good, model, models, 1024).withColumn("__d2", _distance()).select("__g", "__salt", *FEATURES, "__d2")
    cut = far.groupBy("__g").agg(F.percentile_approx("__d2", share, 2000).alias("__cut"))
    near = _beside(far, cut, models, 512).where(F.col("__d2") <= F.col("__cut"))
    return _moments(near, share / _chi2_cdf(chi2_quantile(share, d), d + 2))


def judge(stats: DataFrame, lang: str = "lang", source: str = "source", half: float = HALF, level: float = LEVEL,
          steps: int = STEPS, least: int = LEAST) -> DataFrame:
    """Adds ``distance2`` and ``kept`` to the rows of ``statistics``. Rows that fail the base rule take no part in the
    estimates and are not kept."""
    rows = written(transformed(stats), "statistics").withColumn("__lang", F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))) \
        .withColumn("__src", F.concat("__lang", F.lit("\x00"), F.coalesce(F.concat(F.lit("="), source), F.lit("-"))))
    sizes = written(rows.groupBy("__lang", "__src").agg(F.count_if(~F.col("base_failed")).alias("__n")), "sizes")
    by_lang = written(sizes.groupBy("__lang").agg(F.sum("__n").alias("__nl"), F.min("__n").alias("__fewest")), "languages")
    wide = not by_lang.where(F.col("__nl") < least).isEmpty()
    own = F.when(F.col("__n") >= least, F.col("__src")).when(F.col("__nl") >= least, F.col("__lang")).otherwise(F.lit("*"))
    # a row takes part in its own group's estimate and in each wider one that some group borrows
    feeds = F.array_compact(F.array(F.when(F.col("__n") >= least, F.col("__src")),
                                    F.when((F.col("__nl") >= least) & (F.col("__fewest") < least), F.col("__lang")),
                                    F.lit("*") if wide else F.lit(None).cast("string")))
    named = written(sizes.join(by_lang, "__lang").select("__src", own.alias("__g"), feeds.alias("__feeds")), "groups")
    models = named.select("__g").distinct().count()
    rows = rows.join(small_side(named, named.count(), 1024), "__src").drop("__src", "__lang")
    rows = written(rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "vectors")
    good = rows.where(~F.col("base_failed")).select(F.explode("__feeds").alias("__g"), "__salt", *FEATURES)
    mid = written(good.groupBy("__g").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"m{i}") for i, f in enumerate(FEATURES)],
                                          *[F.percentile_approx(f, [0.25, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)]), "medians")
    start = lambda name: F.concat("__g", F.lit(f"\x01{name}")).alias("__g")
    every = good.select("*", F.explode(F.array(*[F.lit(x) for x in STARTS])).alias("__start")).withColumn("__g", F.concat("__g", F.lit("\x01"), "__start")).drop("__start")
    first = [m.select(start(name), *[c for c in m.columns if c != "__g"]) for name, m in zip(STARTS, _starts(good, mid, models))]
    model = written(first[0].unionByName(first[1]).unionByName(first[2]), "starts")
    for n in range(steps):
        model = written(_concentrated(every, model, models * len(STARTS), half if n else 0.5), "model")
    least_det = F.min_by(F.struct(*[c for c in model.columns if c != "__g"]), F.struct("__det", "__g")).alias("best")
    model = written(model.groupBy(F.regexp_replace("__g", "\x01[^\x01]*$", "").alias("__g")).agg(least_det).select("__g", "best.*"), "model")
    for _ in range(MOST_STEPS):
        new = _concentrated(good, model, models, half)
        both = model.unionByName(new).groupBy("__g").agg(F.min_by(F.struct(*[c for c in model.columns if c != "__g"]), "__det").alias("best"),
                                                         (F.max("__det") - F.min("__det")).alias("__change"))
        stepped = written(both.select("__g", "best.*", "__change"), "model")
        model, moved = stepped.drop("__change"), stepped.where(F.col("__change") > SETTLED).count()
        if not moved:
            break
    out = _beside(rows, model, models, 1024, "left").withColumn("distance2", _distance())
    fine = F.coalesce(F.col("distance2") <= F.lit(chi2_quantile(level, float(len(FEATURES)))), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fine).select(*stats.columns, "distance2", "kept")

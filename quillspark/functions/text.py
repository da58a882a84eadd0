"""Text functions (FN-S*). All are Column -> Column built from JVM-side
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold_table() -> tuple[str, str]:
    """Accent folding pairs built by rule: every lower-case letter of Latin-1
    Supplement and Latin Extended-A whose canonical decomposition starts with
    an ASCII letter maps to that letter; a few letters without decomposition
    are listed as fixed values. One character maps to one character, so
    lengths are unchanged."""
    import unicodedata
    src, dst = [], []
    for cp in range(0xC0, 0x180):
        ch = chr(cp)
        if not ch.isalpha() or ch != ch.lower():
            continue
        base = unicodedata.normalize("NFKD", ch)[0]
        if base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    # Letters without a decomposition.
    for ch, base in (("ß", "s"), ("ł", "l"), ("ø", "o"), ("đ", "d"), ("ħ", "h"), ("ı", "i")):
        if ch not in src:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, FOLDED = _fold_table()
# HTML entities decoded by strip_html, in decoding order.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&amp;", "&")]
WORDS_PER_MINUTE = 213   # our reading rate (the source's rate lives outside it)
SUMMARY_WORDS = 30       # listing summary length in words
ELLIPSIS = "…"


def substr_range(x, start: int, stop: int) -> Column:
    """FN-S1: characters ``start..stop`` (1-based, both ends included)."""
    return F.substring(_c(x), start, stop - start + 1)


def matches(x, pattern: str) -> Column:
    """FN-S2: regex test (``[0]`` is the character class "contains 0")."""
    return _c(x).rlike(pattern)


def replace_first(x, pattern: str, replacement: str) -> Column:
    """FN-S3: replace only the first regex match (``sub`` rather than ``gsub``)."""
    x = _c(x)
    pos = F.regexp_instr(x, F.lit(pattern))
    hit = F.regexp_extract(x, pattern, 0)
    return F.when(pos > 0, F.concat(F.substring(x, F.lit(1), pos - 1), F.lit(replacement),
                                    F.substring(x, pos + F.length(hit), F.lit(1 << 30)))
                  ).otherwise(x)


def replace_all(x, pattern: str, replacement: str) -> Column:
    """FN-S3: replace every match."""
    return F.regexp_replace(_c(x), pattern, replacement)


def swap_parts(x, sep_regex: str = r"\.", joiner: str = "_") -> Column:
    """FN-S4: split, take parts 2 and 1, rejoin."""
    parts = F.split(_c(x), sep_regex)
    return F.concat_ws(joiner, F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)))


def fold_accents(x) -> Column:
    return F.translate(_c(x), ACCENTED, FOLDED)


def slug(x) -> Column:
    """FN-S5: strip markup, lower-case, fold accents, whitespace runs to
    ``-``, keep letters, digits and ``_ - # . + ~``."""
    s = F.regexp_replace(_c(x), r"<[^>]*>", "")
    s = fold_accents(F.lower(s))
    s = F.regexp_replace(F.trim(s), r"\s+", "-")
    return F.regexp_replace(s, r"[^a-z0-9_\-#.+~]", "")


def strip_html(x) -> Column:
    """FN-S6: drop script and style blocks, then tags, decode entities,
    collapse whitespace."""
    s = F.regexp_replace(_c(x), r"(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    for ent, ch in ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def truncate(x, n: int) -> Column:
    """FN-S7: at most ``n`` characters cut at a word break, plus an ellipsis."""
    x = _c(x)
    head = F.substring(x, 1, n + 1)
    at_break = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    cut = F.when(at_break == "", F.substring(x, 1, n)).otherwise(at_break)
    return F.when(F.length(x) <= n, x).otherwise(
        F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(ELLIPSIS)))


def trim_ws(x) -> Column:
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def words(x) -> Column:
    return F.split(trim_ws(x), r"\s+")


def auto_summary(x, n_words: int = SUMMARY_WORDS) -> Column:
    """FN-S8: the first ``n_words`` words."""
    return F.array_join(F.slice(words(x), 1, n_words), " ")


def reading_time(x) -> Column:
    """FN-S9: minutes to read, rounded up."""
    return F.ceil(F.size(words(x)) / F.lit(WORDS_PER_MINUTE)).cast("bigint")


def last_path_part(x) -> Column:
    """FN-S10: last element of a ``/`` path (``path.Base``)."""
    return F.element_at(F.split(F.regexp_replace(_c(x), r"/+$", ""), "/"), -1)


def css_ids(arr, prefix: str = "js-id-") -> Column:
    """FN-S11: map over a list: spaces to ``-`` then prefix."""
    return F.transform(_c(arr), lambda t: F.concat(F.lit(prefix), F.replace(t, F.lit(" "), F.lit("-"))))


def assemble(fields: dict, order: list[str], delimiters: list[str]) -> Column:
    """FN-S12: each non-empty field in ``order`` followed by the delimiter
    at its position; empty fields and their delimiters are skipped, and a
    field without a delimiter of its own is followed by none."""
    delimiters = [*delimiters, *[""] * (len(order) - len(delimiters))][: len(order)]
    vals = F.create_map(*[y for k, v in fields.items() for y in (F.lit(k), _c(v))])
    steps = F.arrays_zip(F.array(*[F.lit(o) for o in order]).alias("k"),
                         F.array(*[F.lit(d) for d in delimiters]).alias("d"))

    def step(acc, e):
        v = F.nullif(F.try_element_at(vals, e["k"]), F.lit(""))
        return F.when(v.isNull(), acc).otherwise(F.concat(acc, v, e["d"]))

    return F.aggregate(steps, F.lit(""), step)


def assemble_by(fields: dict, formats: dict, name, default: str) -> Column:
    """FN-S12 with the format chosen per row: ``formats`` maps a name to
    (order, delimiters); a missing or unknown name takes ``default``."""
    out = assemble(fields, *formats[default])
    for key, (order, delimiters) in formats.items():
        out = F.when(_c(name) == key, assemble(fields, order, delimiters)).otherwise(out)
    return out


def share_url(template: str, url, title) -> Column:
    """FN-S13: fill a share-link template with escaped values (``%20`` spaces)."""
    def esc(v):
        return F.replace(F.url_encode(_c(v)), F.lit("+"), F.lit("%20"))
    s = F.replace(F.lit(template), F.lit("{url}"), esc(url))
    return F.replace(s, F.lit("{title}"), esc(title))


def link_scheme(url) -> Column:
    """FN-S13: classify a link by scheme."""
    u = F.lower(_c(url))
    return (F.when(u.startswith("mailto:"), "email").when(u.startswith("https://"), "secure")
            .when(u.startswith("http://"), "web").otherwise("relative"))


def query_param(url, name: str) -> Column:
    """FN-S13: read a query-string parameter (first occurrence, decoded)."""
    raw = F.regexp_extract(_c(url), rf"[?&]{name}=([^&#]*)", 1)
    return F.when(raw == "", F.lit(None)).otherwise(F.url_decode(F.replace(raw, F.lit("+"), F.lit(" "))))


def email_hash(email) -> Column:
    """FN-S14: avatar key = md5 of the trimmed, lower-cased e-mail."""
    return F.md5(F.lower(F.trim(_c(email))))


def drop_short_link(x) -> Column:
    """FN-S15: remove a trailing short link."""
    return F.regexp_replace(_c(x), r"\s*https://t\.co\S*$", "")


def post_kind(reply_to, text) -> Column:
    """FN-S16: reply / repost / original."""
    return (F.when(_c(reply_to).isNotNull(), "reply")
            .when(_c(text).startswith("RT @"), "repost").otherwise("original"))


def licence_code(allow_commercial, allow_derivatives, share_alike) -> Column:
    """FN-S17: licence code cascaded from three flags."""
    nc = F.when(~F.coalesce(_c(allow_commercial), F.lit(False)), "-nc").otherwise("")
    tail = (F.when(F.coalesce(_c(allow_derivatives), F.lit(False)), "")
            .when(F.coalesce(_c(share_alike), F.lit(False)), "-sa").otherwise("-nd"))
    return F.concat(F.lit("by"), nc, tail)


def citation(style: str, authors, year, title, venue) -> Column:
    """FN-S18: APA or MLA citation text from the parts that are there; a
    missing or empty part goes with its punctuation."""
    def part(x, before: str, after: str) -> Column:
        return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(before), x, F.lit(after))).otherwise("")
    a, t, v = F.array_join(_c(authors), ", "), _c(title), _c(venue)
    y = _c(year).cast("string")
    if style.lower() == "apa":
        return F.trim(F.concat(part(a, "", " "), part(y, "(", "). "), part(t, "", ". "), part(v, "", ".")))
    end = F.when((F.coalesce(v, F.lit("")) != "") | y.isNotNull(), F.concat(F.concat_ws(", ", F.nullif(v, F.lit("")), y), F.lit("."))).otherwise("")
    return F.trim(F.concat(part(a, "", ". "), part(t, '"', '." '), end))


def venue(short, full) -> Column:
    """FN-S18: the short name of a publication's venue, else its full name; null if there is neither."""
    return F.coalesce(F.nullif(_c(short), F.lit("")), F.nullif(_c(full), F.lit("")))


def first_type(types, default: str = "0") -> Column:
    """FLT-09: the type of a record is its first listed type."""
    return F.coalesce(F.get(_c(types), F.lit(0)), F.lit(default))


def page_description(summary, abstract, own, is_page, site: str | None, role: str | None) -> Column:
    """PRJ-08: summary, else abstract, else (pages) the automatic summary, (others) the description of the whole
    collection or its owner's role."""
    text = lambda x: F.nullif(_c(x), F.lit(""))
    rest = F.coalesce(F.nullif(F.lit(site), F.lit("")), F.lit(role).cast("string"))
    return F.coalesce(text(summary), text(abstract), F.when(_c(is_page), _c(own)).otherwise(rest))

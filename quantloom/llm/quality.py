"""Quality rules by distribution divergence.

Each document gets two histograms: character classes, and the common words of its
language. The language references are the same histograms summed over all documents of
that language; the common words are fixed lists of function words. A language without a
list is compared by its character classes alone. A document whose Jensen-Shannon distance (base 2, 0 to 1) from a reference is above the
limit is rejected. Documents of fewer than ``min_words`` words (for common words
``min_words_listed``) are too short to compare and pass. Beside it stand base rules on
length and repetition.

Built-in functions only, and no document is shuffled: all counts are taken inside a row.
Only the language references are aggregated.

Defined cases: null or empty text counts as no words and fails the base rules; null and
empty languages are one language of their own; extra columns pass through; an empty table gives an
empty result. Repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

CLASSES = ("space", "upper", "digit", "punct", "n_symbols", "rest")
CHARS = {"upper": "A-ZÀ-ÖØ-Þ", "digit": "0-9", "punct": r".,;:!?\"'()\-", "n_symbols": "#*$%&|<>"}
#: Sixteen common function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "en": "the of and to a in is that was for on with as be by it".split(),
    "es": "de la que el en y los del se las por un para con no una".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur".split(),
}
LONGEST = max(len(x) for listed in COMMON.values() for x in listed)
#: Words in a repeated window, share of repeated words, least number of words.
WINDOW, MAX_REPEAT, MIN_WORDS = 5, 20, 10
#: References for so many languages at most are broadcast; beyond it they are joined.
BROADCAST_LANGS = 2000


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")


def repeat_words(w: Column) -> Column:
    """Words covered by a window of five words that is found twice or more in the text."""

    def covered(p: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)))
        at = F.sort_array(F.transform(hit, lambda x: x["i"]))
        return let(
            at,
            lambda a: F.aggregate(
                F.transform(a, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda s, x: s + x,
            ),
        )

    def windows(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, covered))

    def joined(x: Column, y: Column, k: int) -> Column:
        # hashes of neighbours: x at i with y at i + k
        n = F.size(w) - WINDOW + 1 if k == WINDOW - 1 else F.size(y) - k
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))

    def of_words(h: Column) -> Column:
        return let(joined(h, h, 1), lambda two: let(joined(two, two, 2), lambda four: let(joined(four, h, 4), windows)))

    one = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(one, of_words))


def common_words(lang: Column) -> Column:
    """The list for a language; empty where there is none."""
    out = F.array().cast("array<string>")
    for name, listed in COMMON.items():
        out = F.when(lang == name, F.array(*map(F.lit, listed))).otherwise(out)
    return out


def _histogram(w: Column, top: Column) -> Column:
    """Counts of the listed words and of all others; empty where no words are listed."""
    common = F.filter(w, lambda x: (F.length(x) <= LONGEST) & F.array_contains(top, x))
    hist = let(
        common,
        lambda c: F.concat(
            F.transform(top, lambda k: F.size(F.filter(c, lambda x: x == k)).cast("long")),
            F.array((F.size(w) - F.size(c)).cast("long")),
        ),
    )
    return F.when(F.size(top) == 0, F.array().cast("array<bigint>")).otherwise(hist)


def _features(docs: DataFrame, text: str, lang: str, whole: bool) -> DataFrame:
    """``docs`` with ``_q``: the class counts and the word histogram; if whole, the base counts too."""
    t = F.coalesce(F.col(text), F.lit(""))
    top = common_words(F.col(lang))

    def counted(w: Column) -> Column:
        word_chars = F.length(F.array_join(w, "")).cast("long")
        # most characters go in long runs; the classes are counted in what is left
        odd = F.regexp_replace(t, "[a-z \\n]+", "")
        classes = let(odd, lambda o: F.struct(*[_count(o, c).alias(n) for n, c in CHARS.items()]))
        out = [
            F.size(w).cast("long").alias("n_words"),
            word_chars.alias("word_chars"),
            (F.length(t) - word_chars).alias("space"),
            classes.alias("classes"),
            let(top, lambda k: _histogram(w, k)).alias("hist"),
        ]
        if whole:
            lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
            out += [
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
            ]
        return F.struct(*out)

    return docs.withColumn("_q", let(words(F.col(text)), counted))


def _classes() -> list[Column]:
    named = [F.col(f"_q.classes.{c}") for c in CHARS]
    rest = F.col("_q.word_chars")
    for c in named:
        rest = rest - c
    return [F.col("_q.space"), *named, rest]


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def language_references(features: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: ``_lang``, ``_ref_chars`` (shares by class), ``_ref_words``
    (shares of the listed words and of all others, empty without a list)."""
    n = 1 + max(map(len, COMMON.values()))
    sums = (
        features.select(
            F.coalesce(F.col(lang), F.lit("")).alias("_lang"),
            *[x.alias(c) for x, c in zip(_classes(), CLASSES, strict=True)],
            *[F.get("_q.hist", F.lit(k)).alias(f"w{k}") for k in range(n)],
        )
        .groupBy("_lang")
        .agg(*[F.sum(c).alias(c) for c in (*CLASSES, *[f"w{k}" for k in range(n)])])
    )
    chars, found = F.array(*CLASSES), F.filter(F.array(*[f"w{k}" for k in range(n)]), lambda x: x.isNotNull())
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return sums.select(
        "_lang", _shares(chars, add(chars)).alias("_ref_chars"), _shares(found, add(found)).alias("_ref_words")
    )


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two aligned share arrays."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_words: int = 50,
    max_char_distance: float = 0.3,
    min_words_listed: int = 100,
    max_word_distance: float = 0.28,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance (null where not compared) and kept.

    Input columns of these names are replaced. Without ``keep_text`` the text column goes
    and the counts of each row, a few hundred bytes, are staged and used for references
    and verdicts; with it, the counts that the references need are taken in a scan of
    their own, since staging whole texts would cost more than a scan.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    made = {*names, "base_failed", "char_distance", "word_distance", "kept", "_q", "_lang", "_ref_chars", "_ref_words"}
    docs = docs.select([c for c in docs.columns if c not in made])
    counted = _features(docs, text, lang, whole=True)
    if keep_text:
        refs = cut(language_references(_features(docs.select(text, lang), text, lang, whole=False), lang))
    else:
        docs = docs.drop(text)
        counted = cut(counted.drop(text))
        refs = cut(language_references(counted, lang))
    few = refs.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    counted = counted.withColumn("_lang", F.coalesce(F.col(lang), F.lit("")))
    # a language may hold most rows, so its references come to the rows by broadcast;
    # with more languages than any catalogue has, by a join that AQE splits
    joined = counted.join(F.broadcast(refs) if few else refs, "_lang", "left")
    q = lambda n: F.col(f"_q.{n}")
    compared = q("n_words") >= min_words
    of_chars = F.when(compared, js_distance(_shares(F.array(*_classes()), q("word_chars") + q("space")), F.col("_ref_chars")))
    listed = (q("n_words") >= min_words_listed) & (F.size(q("hist")) > 0)
    of_words = F.when(listed, js_distance(_shares(q("hist"), q("n_words")), F.col("_ref_words")))
    failed = (q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > MAX_REPEAT * q("n_words"))
    far = lambda d, most: F.coalesce(F.col(d) > most, F.lit(False))
    return joined.select(
        *[F.col(c) for c in docs.columns],
        *[q("classes.n_symbols" if n == "n_symbols" else n).alias(n) for n in names],
        failed.alias("base_failed"),
        F.round(of_chars, 9).alias("char_distance"),
        F.round(of_words, 9).alias("word_distance"),
    ).withColumn(
        "kept", ~F.col("base_failed") & ~far("char_distance", max_char_distance) & ~far("word_distance", max_word_distance)
    )

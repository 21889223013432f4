"""Repetition inside a single document, and other ratios, by a table of thresholds.

A threshold table is a list of rules ``(measure, comparison, value)``.  :func:`compile_rules` turns it into one Spark
projection without user functions: the words of a row, which every measure needs, are bound once, and its lines once where
the table asks for them.  Nothing is shuffled; a text is judged by itself.  Stop words, which differ from corpus to corpus,
are a parameter: :func:`corpus_stop_words` takes the most frequent words of a corpus, of whatever language.

Words are the longest runs of characters other than space, tab, CR and LF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word of the corpus that makes up at least 1/STOP_SHARE of all words is a stop word, if it has a letter.
STOP_SHARE = 500
#: Consecutive words that make a repeated run.
RUN = 6


@dataclass(frozen=True)
class Rule:
    measure: str
    comparison: str  # one of >=, <=, >, <
    value: float


#: A document of at least 50 words of which at least 6/10 are repeated. The second rule costs little and follows from the
#: third, as an n-th occurrence of a word is no first one: a repeated word is never new to its text. So does the rule on
#: length, since 50 words and the blanks between them are 99 characters. The last four hold for any text that gets so far:
#: they keep the other ratios in the table, open, and are tried on no other rows.
REPEATED = (
    Rule("n_chars", ">=", 99),
    Rule("n_words", ">=", 50),
    Rule("new_word_share", "<=", 0.4),
    Rule("repeated_share", ">=", 0.6),
    Rule("mean_word_length", ">=", 1),
    Rule("symbol_ratio", ">=", 0),
    Rule("stop_word_share", "<=", 1),
    Rule("repeated_line_share", "<=", 1),
)
#: Length, symbol, stop-word and line ratios of texts worth a look. Limits as published for filters of web text.
QUALITY = (
    Rule("n_words", ">=", 50),
    Rule("n_words", "<=", 100_000),
    Rule("mean_word_length", ">=", 3),
    Rule("mean_word_length", "<=", 10),
    Rule("symbol_ratio", "<=", 0.1),
    Rule("stop_words", ">=", 2),
    Rule("repeated_line_share", "<=", 0.3),
    Rule("bullet_line_share", "<=", 0.9),
    Rule("ellipsis_line_share", "<=", 0.3),
    Rule("repeated_share", "<=", 0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\r\n]+"))


def lines_of(text: Column) -> Column:
    """Non-blank lines without outer spaces and tabs."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t"))), lambda x: F.length(x) > 0)


def share(part: Column, whole: Column) -> Column:
    """0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def repeated_words(words: Column, run: int = RUN) -> Column:
    """How many words lie in a run of ``run`` words that also begins at an earlier word.

    Runs are compared by a 64-bit hash of their words' 64-bit hashes.  The runs are sorted by hash and place, so each but
    the first of its kind stands next to an equal one; the places of those, in order, cover up to ``run`` words each.
    Sorting makes the work n log n in the words, for texts of any length.
    """
    n = F.size(words)

    def grams(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        return F.transform(F.sequence(F.lit(0), n - run), lambda i: F.struct(F.xxhash64(*[at(i, k) for k in range(run)]).alias("g"), i.alias("i")))

    def repeats(s: Column) -> Column:
        later = F.filter(F.arrays_zip(F.slice(s, 2, F.size(s)).alias("b"), F.slice(s, 1, F.size(s) - 1).alias("a")), lambda p: p["a"]["g"] == p["b"]["g"])
        return F.sort_array(F.transform(later, lambda p: p["b"]["i"]))

    def covered(p: Column) -> Column:
        gap = F.transform(p, lambda x, k: F.least(F.lit(run), F.coalesce(F.get(p, k + 1) - x, F.lit(run))))
        return F.aggregate(gap, F.lit(0), lambda acc, x: acc + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n <= run, F.lit(0)).otherwise(let(hashes, lambda h: let(F.sort_array(grams(h)), lambda s: let(repeats(s), covered))))


def _measures(text: Column, w: Column, x: Column, stop: tuple[str, ...]) -> dict[str, Column]:
    """Every measure, of a text, its words and its lines."""
    n, lines = F.size(w), F.size(x)
    t = F.coalesce(text, F.lit(""))
    words = F.array(*map(F.lit, stop)).cast("array<string>")
    of_lines = lambda f: share(F.size(F.filter(x, f)), lines)
    return {
        "n_chars": F.length(t),
        "n_words": n,
        "mean_word_length": share(F.aggregate(w, F.lit(0), lambda acc, y: acc + F.length(y)), n),
        "symbol_ratio": share(F.length(t) - F.length(F.translate(t, "#…", "")), n),
        "stop_words": F.size(F.array_intersect(F.transform(w, F.lower), words)),
        "stop_word_share": share(F.size(F.filter(w, lambda y: F.array_contains(words, F.lower(y)))), n),
        "new_word_share": share(F.size(F.array_distinct(w)), n),
        "repeated_share": share(repeated_words(w), n),
        "n_lines": lines,
        "repeated_line_share": share(lines - F.size(F.array_distinct(x)), lines),
        "bullet_line_share": of_lines(lambda y: y.rlike(r"^[-*•]")),
        "ellipsis_line_share": of_lines(lambda y: y.rlike(r"(\.\.\.|…)$")),
    }


def _of_lines(measure: str) -> bool:
    return "line" in measure


def measures(docs: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """``key`` and the named measures of every document; of a null, empty or blank text all are 0."""
    t = F.col(text)
    body = lambda w, x: F.struct(*[_measures(t, w, x, stop)[m].alias(m) for m in names])
    both = lambda w: let(lines_of(t), lambda x: body(w, x)) if any(map(_of_lines, names)) else body(w, w)
    return docs.select(key, let(words_of(t), both).alias("__m")).select(key, *[F.col(f"__m.{m}").alias(m) for m in names])


def compile_rules(rules: tuple[Rule, ...], text: Column, stop: tuple[str, ...] = ()) -> Column:
    """One boolean column: whether a text meets all rules.  They are tried in the table's order, and the first that fails
    spares the row the rest; words and lines are made when the first rule that needs them is reached."""

    def of_length(rest: tuple[Rule, ...]) -> Column:
        if not rest or rest[0].measure != "n_chars":
            return let(words_of(text), lambda w: verdict(w, None, rest)) if rest else F.lit(True)
        return F.when(met(F.length(F.coalesce(text, F.lit(""))), rest[0]), of_length(rest[1:])).otherwise(False)

    def met(m: Column, r: Rule) -> Column:
        return {">=": m >= r.value, "<=": m <= r.value, ">": m > r.value, "<": m < r.value}[r.comparison]

    def verdict(w: Column, x: Column | None, rest: tuple[Rule, ...]) -> Column:
        if not rest:
            return F.lit(True)
        r = rest[0]
        if x is None and _of_lines(r.measure):
            return let(lines_of(text), lambda y: verdict(w, y, rest))
        m = _measures(text, w, w if x is None else x, stop)[r.measure]
        return F.when(met(m, r), verdict(w, x, rest[1:])).otherwise(False)

    return of_length(rules)


def corpus_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``: every word of every text, in lower case."""
    return docs.select(F.explode(words_of(F.col(text))).alias("word")).select(F.lower("word").alias("word"))


def corpus_stop_words(docs: DataFrame, text: str = "text", share_of: int = STOP_SHARE) -> tuple[str, ...]:
    """The words with a letter that make up at least 1/share_of of all words of a corpus, in order.

    They come from the majority-vote sketch and an exact count, so memory is bounded; there are at most share_of of them.
    """
    from terrafold.llm import heavy_hitters

    found = heavy_hitters.frequent(corpus_words(docs, text), ["word"], share_of)
    return tuple(sorted(r["word"] for r in found.where(F.col("word").rlike(r"\p{L}")).select("word").collect()))


def matching(docs: DataFrame, rules: tuple[Rule, ...] = REPEATED, key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = ()) -> DataFrame:
    """The keys of documents that meet all rules."""
    return docs.select(key, compile_rules(rules, F.col(text), stop).alias("__met")).where("__met").select(key)

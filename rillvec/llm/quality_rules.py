"""Quality rules as a short-circuit cascade.

Every rule is a predicate that rejects a document.  ``order_rules`` measures
each rule on a bounded sample: the seconds it takes and the share it rejects.
The sample is drawn from all of the table; each rule runs once to warm up and
counts by the best of ``RUNS`` runs.  Rules then run by rejection per cost,
highest first, as one nested CASE expression, so a document that an early rule
rejects never pays for a later one.  The order changes the cost and never the
verdict.  ``annotate`` owes some counts for every row: rules read those, and
what else a rule asks for is computed only for rows that reach it.

Edge cases: null and empty texts have no words and fail ``few_words``; ties
and repeated rows are judged one by one; extra columns pass through
``cascade`` untouched; an empty table gives an empty result; texts are read
whole whatever their length (up to 2**28 words).
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import WORD, let, pinned, text_of, words_of

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1000
RUNS = 3
SYMBOLS = "#*$%&|<>"
_POSITION_BITS = 28


@dataclass(frozen=True)
class Features:
    """Columns that rules read; each is evaluated only where a rule asks for it."""

    text: Column
    words: Column

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, "")).cast("long")

    @property
    def n_symbols(self) -> Column:
        return (F.length(self.text) - F.length(F.translate(self.text, SYMBOLS, ""))).cast("long")

    @property
    def n_lines(self) -> Column:
        return F.size(_worded_lines(self.text))

    @property
    def n_dup_lines(self) -> Column:
        return let(_worded_lines(self.text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")

    @property
    def n_repeat_words(self) -> Column:
        return repeat_words(self.words)


#: The counts that ``annotate`` returns.
OWED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Counted(Features):
    """The same where the owed counts are columns already; others are still computed where a rule asks."""

    def __getattribute__(self, name: str) -> Column:
        return F.col(name) if name in OWED else object.__getattribute__(self, name)


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, text and the owed counts."""
    rows = pinned(docs, *keep, "text").withColumn("text", text_of("text")).withColumn("words", words_of(F.col("text")))
    f = Features(F.col("text"), F.col("words"))
    return rows.select(*keep, "text", *[getattr(f, name).alias(name) for name in OWED])


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], Column]


RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeat_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 12 * f.n_words)),
    Rule("symbols", lambda f: 4 * f.n_symbols > f.n_words),
    Rule("dup_lines", lambda f: 10 * f.n_dup_lines > 4 * f.n_lines),
)


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that stands twice or more in the text.

    Windows are hashed; only where two hashes are equal the hash and position
    are sorted as one long, and the windows found so are compared as text.
    """
    return let(words, _repeat_words)


def _repeat_words(words: Column) -> Column:
    n = F.size(words)

    def window(w: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def positions(h: Column) -> Column:
        low = (1 << _POSITION_BITS) - 1
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        def twin(p: Column, x: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.shiftright(F.get(p, j), _POSITION_BITS) == F.shiftright(x, _POSITION_BITS), F.lit(False))
            return F.when((i > 0) & same(i - 1) | same(i + 1), x.bitwiseAND(F.lit(low)).cast("int"))

        return let(packed, lambda p: F.filter(F.transform(p, lambda x, i: twin(p, x, i)), lambda x: x.isNotNull()))

    def covered(found: Column) -> Column:
        spans = F.array_sort(F.transform(found, lambda i: F.struct(window(words, i).alias("w"), i.alias("i"))))

        def equal(s: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["w"] == F.get(s, i)["w"], F.lit(False))
            return (i > 0) & same(i - 1) | same(i + 1)

        sure = let(spans, lambda s: F.filter(s, lambda _x, i: equal(s, i)))
        starts = F.transform(sure, lambda x: x["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def features_of(docs: DataFrame, text: str = "text") -> Features:
    return Features(text_of(text), words_of(text_of(text)))


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, paid: bool = False) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), by rejection per second on a sample of about ``sample_rows`` rows.

    The sample sets the order of evaluation and nothing else.  ``paid`` says
    that the owed counts are there already and cost nothing.
    """
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    share = min(1.0, sample_rows / max(1, texts.count()))
    sample = texts.sample(share, 7) if share < 1 else texts
    sample = (counted(sample) if paid else sample).coalesce(8).persist()
    try:
        total = max(1, sample.count())
        features = Counted(F.col("text"), F.lit(None)) if paid else features_of(sample)
        bare = _seconds(sample, F.length(text_of("text")) < 0)[0]
        found = []
        for rule in rules:
            seconds, rejected = _seconds(sample, rule.rejects(features))
            found.append((rule, max(seconds - bare, 1e-4), rejected / total))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def _seconds(sample: DataFrame, predicate: Column) -> tuple[float, int]:
    """The best of some runs after a first one that warms up, and the rows for which the predicate holds."""
    asked = sample.agg(F.count_if(F.coalesce(predicate, F.lit(False))))
    n, best = asked.first()[0], math.inf
    for _ in range(RUNS):
        began = time.perf_counter()
        asked.first()
        best = min(best, time.perf_counter() - began)
    return best, n


def verdict(ordered: Sequence[tuple[Rule, float, float]], features: Features) -> Column:
    """Name of the first rule that rejects, null if none does: a lazy chain."""
    chain = F.lit(None).cast("string")
    for rule, _, _ in reversed(ordered):
        chain = F.when(rule.rejects(features), F.lit(rule.name)).otherwise(chain)
    return chain


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents no rule rejects, with all their columns."""
    ordered = order_rules(docs, rules, text)
    body = text_of(text)
    return docs.where(let(words_of(body), lambda words: verdict(ordered, Features(body, words))).isNull())


def annotate(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed and kept of every row."""
    ordered = order_rules(docs, rules, paid=True)
    rows = counted(docs, "doc_id")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("rejected_by", verdict(ordered, Counted(F.col("text"), F.lit(None))))
    return judged.select("doc_id", *OWED, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))

"""Small building blocks for operators made of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillvec.plans.durable import durable

__all__ = ["BLANKS", "WORD", "durable", "let", "pinned", "text_of", "words_of"]

#: The characters that part words: space, tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text: runs of characters that are not blanks."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def pinned(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so extra columns can't clash with those an operator adds."""
    return docs.select(*[F.col(f"`{n}`") for n in names])

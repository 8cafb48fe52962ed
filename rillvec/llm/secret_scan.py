"""Secret scans: pattern spans, and spans of high entropy, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns.  The
method adds spans of kind ``entropy``: candidate strings (long runs of
characters that keys are made of) are read through a sliding window; per
character class, the counts of the window's characters are kept in an array
that gains one character and loses one at every step, together with the sum of
c log2 c, from which the Shannon entropy follows without a recount.  A
candidate whose peak entropy passes its class's threshold is a secret, unless
it is on the allow list (identifiers, paths, placeholders).  Candidates are
looked for in the text with its base spans blanked out, so what is left and
right of a base span is scanned as well.

Spark's matcher gives texts and no places, so places come from splitting by
the same pattern: the pieces between matches and the matches themselves, laid
end to end, are the text.  Running sums over them take a few passes of wider
and wider steps, and texts are cut from a copy with four bytes a code point,
where a cut costs its own length: n matches take n log n steps.

Edge cases: a null text is empty and has no spans; ties (two kinds that start
together) are ordered by kind as listed; repeated rows are scanned one by one;
extra columns pass through ``redact`` untouched and are ignored by ``scan``;
an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import let, pinned, text_of

# The three base patterns, the group that counts, its least length.  Runs of the last
# two are maximal, so a least length inside the pattern drops the same matches as a check after it.
BASE: tuple[tuple[str, str, int, int], ...] = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings, the window, and per class: its characters and the bits of entropy that a window must exceed.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES: tuple[tuple[str, str, float], ...] = (
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("alphanumeric", r"^[0-9A-Za-z]+$", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: Suppressed candidates: words and paths without a digit; numbers.
ALLOW: tuple[str, ...] = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
)
#: Suppressed values, which are what follows a candidate's last inner "=": UUIDs; placeholders.
VALUE = r"[^=]+=*$"
ALLOW_VALUE: tuple[str, ...] = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|xxxx|changeme|your[_-]?key",
)
#: Running sums: FAN ** FAN_STEPS matches a text, which is 2**24.
FAN, FAN_STEPS = 16, 6

_SPAN = "struct<start:int,kind:int,end:int>"


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array: step k adds the FAN - 1 values that stand FAN**k, 2 FAN**k, ... places before."""

    def step(far: int) -> Callable[[Column], Column]:
        def reach(x: Column, v: Column, i: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(far), F.least(i, F.lit(far * (FAN - 1))), F.lit(far)), v, lambda sum_, back: join(sum_, F.get(x, i - back)))

        return lambda x: F.when(F.size(x) > far, F.transform(x, lambda v, i: F.when(i >= far, reach(x, v, i)).otherwise(v))).otherwise(x)

    for k in range(FAN_STEPS):
        values = let(values, step(FAN**k))
    return values


def _find(text: Column, pattern: str, kind: int, likely: str, fits: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Array of (start, kind, end) of the matches that fit (match, its group), in code points."""

    def place(found: Column, own: Column, pieces: Column) -> Column:
        lengths = F.transform(found, lambda x, i: F.length(F.get(pieces, i)) + F.length(x))
        spans = F.transform(_running(lengths, lambda a, b: a + b), lambda end, i: F.struct((end - F.length(F.get(found, i))).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.filter(spans, lambda _, i: fits(F.get(found, i), F.get(own, i)))

    none = F.array().cast(f"array<{_SPAN}>")
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    own = (lambda found, body: let(all_of(group), lambda g: body(found, g))) if group else (lambda found, body: body(found, found))
    whole = let(all_of(0), lambda found: own(found, lambda f, g: let(F.split(text, pattern, -1), lambda pieces: place(f, g, pieces))))
    return F.when(text.rlike(likely), whole).otherwise(none)


def _likely(pattern: str, least: int) -> str:
    """A pattern that matches wherever a long enough group can stand; cheap where there is none."""
    return f"{pattern[:-2]}{{{least}}})" if pattern.endswith("+)") else pattern


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest entropy, in bits, of a window of the string, by incremental counts of its distinct characters."""

    def log(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def peak(chars: Column, kinds: Column) -> Column:
        codes = F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int"))

        def step(state: Column, i: Column, places: Column) -> Column:
            comes = F.get(places, i)
            goes = F.when(i >= window, F.get(places, i - window)).otherwise(F.lit(-1))
            n_in, n_out = F.get(state["counts"], comes), F.get(state["counts"], goes)
            gain = log(n_in + 1) - log(n_in) + F.when(goes >= 0, log(n_out - 1) - log(n_out)).otherwise(F.lit(0.0))
            counts = F.transform(state["counts"], lambda c, k: c + F.when(k == comes, 1).otherwise(0) - F.when(k == goes, 1).otherwise(0))
            moved = F.when(comes == goes, F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"))).otherwise(F.struct(counts.alias("counts"), (state["sum"] + gain).alias("sum")))
            return let(moved, lambda m: F.struct(m["counts"].alias("counts"), m["sum"].alias("sum"), F.when(i >= window - 1, F.least(state["least"], m["sum"])).otherwise(state["least"]).alias("least")))

        zero = F.struct(F.array_repeat(F.lit(0), F.size(kinds)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
        return let(codes, lambda places: F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), zero, lambda state, i: step(state, i, places), lambda s: s["least"]))

    least = let(F.filter(F.split(candidate, "", -1), lambda c: c != ""), lambda chars: let(F.array_distinct(chars), lambda kinds: peak(chars, kinds)))
    return F.lit(math.log2(window)) - least / window


def is_secret(candidate: Column) -> Column:
    """Does a candidate string pass its class's entropy, and is it not on the allow list?"""
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    for pattern in ALLOW_VALUE:
        allowed = allowed | F.regexp_extract(candidate, VALUE, 0).rlike(pattern)
    need = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        need = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(need)
    return F.when(allowed, F.lit(False)).otherwise(peak_entropy(candidate) > need)


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with sorted spans replaced by ``mark`` of a span's start, its end and the furthest end before it."""

    def put(wide: Column, reach: Column) -> Column:
        # Cuts go through a code point before them, as a leading byte order mark would be lost.
        cut = lambda at, n: F.substring(F.decode(F.concat(F.lit(bytearray(b"\0\0\0.")), F.substring(wide, at * 4 + 1, n * 4)), "UTF-32"), 2, 2**31 - 1)
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.concat(F.when(s["start"] > before(i), cut(before(i), s["start"] - before(i))).otherwise(F.lit("")), mark(s["start"], s["end"], before(i))))
        last = F.element_at(reach, -1)
        return F.concat(F.array_join(pieces, ""), cut(last, F.length(text) - last))

    return let(F.encode(text, "UTF-32"), lambda wide: let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), lambda reach: put(wide, reach)))


def _spans(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The kept columns, ``__base`` and ``__all``; spans are computed once."""
    raw = F.concat(*[_find(F.col("__text"), pattern, k, _likely(pattern, least), lambda _, own, n=least: F.length(own) >= n, group if group > 1 else 0) for k, (_, pattern, group, least) in enumerate(BASE)])
    rows = docs.select(*keep, text.alias("__text")).withColumn("__base", F.array_sort(raw))
    blanked = _replaced(F.col("__text"), F.col("__base"), lambda start, end, reach: F.repeat(F.lit(" "), F.greatest(end - F.greatest(start, reach), F.lit(0))))
    rows = rows.withColumn("__rest", F.when(F.size("__base") == 0, F.col("__text")).otherwise(blanked))
    secret = _find(F.col("__rest"), CANDIDATE, len(BASE), CANDIDATE, lambda found, _: is_secret(found))
    return rows.withColumn("__more", secret).withColumn("__all", F.when(F.size("__more") == 0, F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__more"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    rows = _spans(pinned(docs, "doc_id", "text"), text_of("text"), F.col("doc_id"))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_said(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _said(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``, and ``n_chars`` made to fit where there is one."""
    rows = _spans(docs, F.col("text"), F.col("*"))
    # Spans that overlap share a mark.
    clean = _replaced(F.col("__text"), F.col("__all"), lambda start, _, reach: F.when(start >= reach, F.lit(mark)).otherwise(F.lit("")))
    out = rows.withColumn("text", F.when(F.size("__all") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__all") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Personal data in texts, by Spark SQL functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod 97 for IBANs, ranges for addresses, digit
counts for phones), and words near a span raise or lower its score. A kind's proposals are leftmost and do not overlap;
one that fails its check is dropped and nothing inside it is tried again.

The patterns are written so that a search is linear in the text: loops that never go back or are bounded, and anchors that
keep a search from starting again inside a run that has failed. ``split`` gives the texts between proposals and
``regexp_extract_all`` the proposals; running sums of their lengths give positions in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.llm.common import columns, packed, unpacked

LOCAL = "[A-Za-z0-9._%+-]"
NEAR = 40  # characters before and after a span that may hold context words


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the Luhn check."""
    digits = F.reverse(F.translate(match, " -", ""))
    doubled = F.translate(digits, "0123456789", "0246813579")

    def digit(i: Column) -> Column:
        return F.when(i % 2 == 0, F.substring(doubled, i, F.lit(1))).otherwise(F.substring(digits, i, F.lit(1))).cast("int")

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + digit(i))
    return total % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's remainder is 1: its first four characters put last, letters read as 10 to 35."""
    plain = F.translate(match, " ", "")
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(rest: Column, i: Column) -> Column:
        value = F.position(F.substring(turned, i, F.lit(1)), letters) - 1
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    passes: Callable[[Column], Column]
    hint: str  # a cheap test that every text with a proposal passes
    score: float
    context: str  # words that raise the score when they stand near the span
    base: bool = True


# Letters and digits of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An IBAN as long as its country's are, so that the next word is never taken for a part of it.

    Other lengths and countries are tried after that, longest first, up to the place where an IBAN of a known length
    begins. Every loop is bounded, so the search stays linear.
    """
    known = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    known = rf"(?:{known})(?![A-Za-z0-9])"
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20(?!{known})[A-Z0-9]|[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})"


PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"

KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        "@",
        0.9,
        "mail|contact|write",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda m: m.rlike(rf"^(?:{PART}\.){{3}}{PART}$"),
        r"[0-9]\.[0-9]",
        0.6,
        "ip|address|server|host",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda m: F.when(_digits(m).between(16, 19), luhn(m)).otherwise(False),
        r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
        0.9,
        "card|visa|credit|pay",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: _digits(m).between(8, 15),
        r"\+[0-9]",
        0.7,
        "phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        _iban(),
        lambda m: F.when(F.length(F.translate(m, " ", "")).between(15, 34), mod97(m)).otherwise(False),
        "[A-Z]{2}[0-9]{2}",
        0.95,
        "iban|account|bank|konto|compte|cuenta",
        base=False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"),
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.3,
        "ssn|social security",
        base=False,
    ),
)
RAISE, LOWER, LEAST = 0.3, 0.2, 0.5
AGAINST = "example|version|sample|order no"


def _proposals(text: Column, kind: Kind) -> Column:
    """Pairs of the text before a proposal and the proposal; the last pair has only the text that is left."""
    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.transform(gaps, lambda gap, i: F.struct(gap.alias("gap"), F.get(found, i).alias("match")))


def _near(pairs: Column, at: Column) -> Column:
    """The ``NEAR`` characters on either side of the proposal in pair ``at``, by position, other proposals included."""
    empty = F.lit("")

    def part(x: Column, ahead: bool) -> Column:  # enough of a gap or a proposal, from the side of the span
        return F.coalesce(F.substring(x, 1 if ahead else -NEAR, NEAR), empty)

    # Of any kind, two proposals with the gap between them have two characters or more.
    steps = F.sequence(F.lit(1), F.lit(NEAR // 2))

    def back(seen: Column, j: Column) -> Column:
        pair = F.get(pairs, at - j)
        more = F.concat(part(pair.gap, False), part(pair.match, False), seen)
        return F.when((F.length(seen) < NEAR) & (j <= at), more).otherwise(seen)

    def on(seen: Column, j: Column) -> Column:
        pair = F.get(pairs, at + j)
        more = F.concat(seen, part(pair.gap, True), part(pair.match, True))
        return F.when((F.length(seen) < NEAR) & pair.isNotNull(), more).otherwise(seen)

    before = F.aggregate(steps, part(F.get(pairs, at).gap, False), back)
    after = F.aggregate(steps, empty, on)
    return F.lower(F.concat(F.substring(before, -NEAR, NEAR), F.lit("\n"), F.substring(after, 1, NEAR)))


def _score(kind: Kind, pairs: Column, at: Column) -> Column:
    near = F.array(_near(pairs, at))  # worked out once
    told = F.transform(
        near,
        lambda x: F.lit(kind.score) + F.when(x.rlike(kind.context), RAISE).otherwise(0.0) - F.when(x.rlike(AGAINST), LOWER).otherwise(0.0),
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(told, F.lit(0)))), 2)


def _accepted(kind: Kind, pairs: Column, at: Column, match: Column) -> Column:
    """Base kinds stay whatever their score; the others need a score of ``LEAST``."""
    fine = F.coalesce(kind.passes(match), F.lit(False)) & match.isNotNull()
    return fine if kind.base else F.when(fine, _score(kind, pairs, at) >= LEAST).otherwise(False)


BLOCK = 256
SPAN = "array<struct<kind:string,begin:int,end:int,score:double>>"


def kind_spans(pairs: Column, kind: Kind) -> Column:
    """The accepted spans among ``_proposals``, by position; ``end`` is exclusive, positions count code points.

    ``pairs`` must be a column of the input: it is read again for every block.
    """
    empty = F.expr(f"CAST(array() AS {SPAN})")

    def step(state: Column, pair: Column) -> Column:
        begin = state.at + F.length(pair.gap)
        end = begin + F.coalesce(F.length(pair.match), F.lit(0))
        span = F.struct(
            F.lit(kind.name).alias("kind"), begin.alias("begin"), end.alias("end"), _score(kind, pairs, state.number).alias("score")
        )
        out = F.when(_accepted(kind, pairs, state.number, pair.match), F.concat(state.out, F.array(span))).otherwise(state.out)
        return F.struct(end.alias("at"), (state.number + 1).alias("number"), out.cast(SPAN).alias("out"))

    def block(state: Column, number: Column) -> Column:
        some = F.slice(pairs, number * BLOCK + 1, F.lit(BLOCK))
        first = F.struct(state.at.alias("at"), (number * BLOCK).alias("number"), empty.alias("out"))
        done = F.aggregate(some, first, step)
        return F.struct(done.at.alias("at"), F.concat(state.blocks, F.array(done.out)).alias("blocks"))

    # Appending copies the array, so spans are gathered by block: texts with very many stay near linear.
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{SPAN}>)").alias("blocks"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    found = F.aggregate(numbers, start, block, lambda state: F.flatten(state.blocks))
    return F.when(F.size(pairs) > 1, found).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, and an array of spans for each kind of ``KINDS``.

    A null text has no spans, like an empty one. Repeated rows give repeated rows; whole texts are searched.
    """
    rows = columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    pairs = [F.when(text.rlike(kind.hint), _proposals(text, kind)).otherwise(F.array()).alias(kind.name) for kind in KINDS]
    return rows.select("doc_id", *pairs).select("doc_id", *[kind_spans(F.col(k.name), k).alias(k.name) for k in KINDS])


def listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans of the kinds, comma-joined, kinds in the order given."""
    every = F.concat(*[F.col(k) for k in kinds])
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s.kind, s.begin.cast("string"), s.end.cast("string"))), ",")


def _without(text: Column, pairs: Column, kind: Kind) -> Column:
    """``pairs``, the ``_proposals`` in ``text``, must be a column of the input: each is read again for its neighbours."""

    def shown(pair: Column, at: Column) -> Column:
        return F.concat(
            pair.gap, F.when(_accepted(kind, pairs, at, pair.match), f"<{kind.name.upper()}>").otherwise(F.coalesce(pair.match, F.lit("")))
        )

    return F.when(F.size(pairs) > 1, F.array_join(F.transform(pairs, shown), "")).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each accepted span replaced by its kind in angle brackets.

    Kinds are replaced one after another, in the order of ``KINDS``. Texts without spans, null and empty ones included,
    pass untouched.
    """
    rows = packed(docs).withColumn("old", F.col("text"))
    text, pairs = F.col("text"), F.col("pairs")

    def without(df: DataFrame, kind: Kind) -> DataFrame:
        found = df.withColumn("pairs", F.when(text.rlike(kind.hint), _proposals(text, kind)))
        return found.withColumn("text", _without(text, pairs, kind)).drop("pairs")

    rows = reduce(without, KINDS, rows)
    return unpacked(rows, docs, ~F.col("text").eqNullSafe(F.col("old")))

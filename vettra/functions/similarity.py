"""Name similarity: twice the longest common subsequence over the summed lengths, as native expressions.

The subsequence length is found bit-parallel (Allison and Dix; Hyyro): words of 62 bits hold a whole row of the dynamic
programme, and the carry of each addition is passed on to the next word. One side's letter masks are computed once per
name, the other side is a fold over its letters. The expression takes names of all lengths; tables of pairs of long names
take :func:`long_similarity`, the same algorithm on Python's whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.constants import DIFFERENT_DOB_CAP, SAME_DOB_BOOST, SCORE_DIGITS
from vettra.functions.binding import bind
from vettra.functions.names import canonical_name, token_sorted

# Bits of a word: v + (v & m) + carry stays within a signed long (Spark checks overflow).
WORD_BITS = 62
WORD_FULL = (1 << WORD_BITS) - 1

# Letters of Latin names, rare first. Only speed depends on this order.
RARE_FIRST = "9876543210_qxjwz'yfvpbgck-hdumtlsrnoie a"


def letter_bag(name: Column) -> Column:
    """Letters numbered by repeat, as integers sorted rare first: two bags intersect like multisets.

    Repeats are counted a letter, not looked for in the name, so the work is the name's length times its distinct letters.
    """

    def coded(known: Column) -> Column:
        def codes(letter: Column) -> Column:
            # One number less by 12 ranks a repeat: a sequence, so nothing is worked out a letter.
            count = F.length(known.text) - F.length(F.replace(known.text, letter, F.lit("")))
            first = ((F.instr(F.lit(RARE_FIRST), letter) + 65536) * 256 + F.ascii(letter)).cast("int")
            return bind(first, lambda x: F.sequence(x, (x - (count - 1) * 3072).cast("int"), F.lit(-3072)))

        return F.flatten(F.transform(known.letters, codes))

    letters = F.array_distinct(F.split(name, ""))
    none = F.array().cast("array<int>")
    return F.when(name == "", none).when(name != "", F.sort_array(bind(F.struct(name.alias("text"), letters.alias("letters")), coded)))


def repeat_of(code: Column) -> Column:
    """Which repeat of its letter, from 0, an element of a letter bag stands for."""
    ranks = F.array(*[F.lit(RARE_FIRST.find(chr(i)) + 1) for i in range(128)])
    rank = F.get(ranks, code.bitwiseAND(F.lit(127)))
    return ((rank + 65536 - F.shiftright(code, 8)) / 12).cast("int")


def letter_masks(name: Column) -> Column:
    """struct<letters:string, masks:array<array<bigint>>>: the name's distinct letters, and a mask for each of them.

    Bit i of word w is set where the name's letter 62 w + i is that letter: the word's letters written as ones and noughts,
    last one first, and read as a binary number. Only letters that occur have a mask.
    """

    def of(known: Column) -> Column:
        n = F.length(known.letters)

        def words_of(i: Column) -> Column:
            digits = F.concat(F.repeat(F.lit("0"), i), F.lit("1"), F.repeat(F.lit("0"), n - i - 1))
            binary = lambda part: F.conv(F.reverse(F.call_function("translate", part, known.letters, digits)), 2, 10)
            return F.transform(known.parts, lambda part: binary(part).cast("bigint"))

        masks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), words_of))
        return F.struct(known.letters.alias("letters"), masks.alias("masks"))

    letters = F.array_join(F.array_distinct(F.split(name, "")), "")
    parts = F.regexp_extract_all(name, F.lit(f".{{1,{WORD_BITS}}}"), F.lit(0))
    return bind(F.struct(letters.alias("letters"), parts.alias("parts")), of)


def _next_row(row: Column, mask: Column) -> Column:
    """The row after one more letter: (v + (v & m)) | (v & ~m), the addition running over all words."""

    def word(acc: Column, v: Column) -> Column:
        hit = v.bitwiseAND(F.get(mask, F.size(acc.row)))
        total = v + hit + acc.carry
        return F.struct(
            F.array_append(acc.row, total.bitwiseAND(F.lit(WORD_FULL)).bitwiseOR(v - hit)).alias("row"),
            F.shiftright(total, WORD_BITS).alias("carry"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).cast("bigint").alias("carry"))
    return F.aggregate(row, start, word, lambda acc: acc.row)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two canonical names: the zero bits of the last row."""

    def fold(known: Column) -> Column:
        def step(row: Column, letter: Column) -> Column:
            # A letter that the other name lacks leaves the row as it is.
            mask = F.get(known.masks, F.instr(known.letters, letter) - 1)
            return bind(mask, lambda mask: F.when(mask.isNull(), row).otherwise(_next_row(row, mask)))

        def zeros(row: Column) -> Column:
            return F.aggregate(row, F.lit(0), lambda n, v: n + WORD_BITS - F.bit_count(v))

        return F.aggregate(F.split(known.b, ""), F.array_repeat(F.lit(WORD_FULL), F.size(known.masks[0])), step, zeros)

    def of(pair: Column) -> Column:
        masks = letter_masks(pair.a)
        facts = bind(masks, lambda m: F.struct(m.letters.alias("letters"), m.masks.alias("masks"), pair.b.alias("b")))
        empty = (F.length(pair.a) == 0) | (F.length(pair.b) == 0)
        return F.when(empty, 0).when(~empty, bind(facts, fold))

    return bind(F.struct(a.alias("a"), b.alias("b")), of)


def ratio_of(lcs: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs / total)


def ratio(a: Column, b: Column) -> Column:
    return ratio_of(lcs_length(a, b), a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """Best of the plain and the token-sorted ratio of two canonical names. Substrings do not score as equal."""

    def best(pair: Column) -> Column:
        ordered = lcs_length(token_sorted(pair.a), token_sorted(pair.b))
        return ratio_of(F.greatest(lcs_length(pair.a, pair.b), ordered), pair.a, pair.b)

    return bind(F.struct(a.alias("a"), b.alias("b")), best)


def long_similarity(pairs: DataFrame, per_10000: int) -> DataFrame:
    """Add ``base`` to rows with canonical_name and entry_cname, which may be long: :func:`name_similarity` where the
    letters in common can reach ``per_10000``, else null.

    One whole number holds a row of the dynamic programme, however long the names are.
    """

    def lcs(a: str, b: str, needed: int) -> int:
        """0 as soon as fewer than ``needed`` are sure."""
        masks: dict[str, int] = {}
        for i, letter in enumerate(a):
            masks[letter] = masks.get(letter, 0) | 1 << i
        full = row = (1 << len(a)) - 1
        found = 0
        for at in range(0, len(b), 64):
            for letter in b[at : at + 64]:
                if hit := row & masks.get(letter, 0):
                    row = row + hit | row - hit
            found = len(a) - (row & full).bit_count()
            if found + max(0, len(b) - at - 64) < needed:
                return 0
        return found

    def ordered(name: str) -> str:
        return " ".join(sorted(name.split(" ")))

    def base(a: str, b: str) -> float | None:
        total = len(a) + len(b)
        needed = (per_10000 * total + 19999) // 20000
        if min(len(a), len(b)) < needed or sum(min(a.count(c), b.count(c)) for c in set(a)) < needed:
            return None
        found = max(lcs(b, a, needed), lcs(ordered(a), ordered(b), needed))
        return 2.0 * found / total if found >= needed else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("canonical_name", "entry_cname"))
            told = pa.array([base(a, b) for a, b in zip(*names, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], [*batch.schema.names, "base"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("base", T.DoubleType())]))


def dob_relation(left: Column, right: Column) -> Column:
    return F.when(left.isNull() | right.isNull(), "unknown").when(left == right, "same").otherwise("different")


def with_dob(base: Column, relation: Column) -> Column:
    """Apply birth-date evidence to a name similarity: cap a contradiction, lift an agreement."""
    value = (
        F.when(relation == "different", F.least(base, F.lit(DIFFERENT_DOB_CAP)))
        .when(relation == "same", F.least(F.lit(1.0), base + SAME_DOB_BOOST))
        .otherwise(base)
    )
    return F.bround(value, SCORE_DIGITS)


def score_pair(profile_name: Column, other_name: Column, dob: Column, other_dob: Column) -> Column:
    return with_dob(
        name_similarity(canonical_name(profile_name), canonical_name(other_name)), dob_relation(dob, other_dob)
    )

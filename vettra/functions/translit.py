"""Romanisation to ASCII as a Column expression.

Accented Latin and Greek letters come from a rule (canonical decomposition, marks dropped), so the table stays
short. Hangul is spelled by syllable arithmetic and kana by rows and columns of the sound table. Letters that no rule
covers are listed as fixed values. Han needs a large table and is passed in through ``extra``. A letter nobody maps is
dropped; :func:`dropped_letters` counts those, so that no name gets lost unseen.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: romanisation of single letters ----------------------------------------------------------------
CYRILLIC_LOWER = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e",
    "ю": "iu", "я": "ia", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j",
    "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "ў": "u", "џ": "dzh",
}
GREEK_LOWER = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k",
    "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t",
    "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
LATIN_OTHER = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th",
    "Þ": "Th", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ĳ": "ij", "Ĳ": "IJ", "œ": "oe", "Œ": "OE",
    "ŧ": "t", "Ŧ": "T", "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ſ": "s",
}
ARABIC = {
    "آ": "a", "أ": "'", "ؤ": "w'", "ئ": "y'", "ب": "b", "ة": "@", "ت": "t", "ث": "th", "ج": "j", "ح": "H",
    "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "S", "ض": "D", "ط": "T",
    "ظ": "Z", "ع": "`", "غ": "G", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h",
    "و": "w", "ى": "~", "ي": "y",
}
HEBREW = {
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "ך": "k",
    "כ": "k", "ל": "l", "ם": "m", "מ": "m", "ן": "n", "נ": "n", "ס": "s", "ע": "'", "ף": "p", "פ": "p", "ץ": "ts",
    "צ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
}
ARMENIAN_LOWER = {
    "ա": "a", "բ": "b", "գ": "g", "դ": "d", "ե": "e", "զ": "z", "է": "e", "ը": "e", "թ": "t", "ժ": "zh", "ի": "i",
    "լ": "l", "խ": "kh", "ծ": "ts", "կ": "k", "հ": "h", "ձ": "dz", "ղ": "gh", "ճ": "ch", "մ": "m", "յ": "y", "ն": "n",
    "շ": "sh", "ո": "o", "չ": "ch", "պ": "p", "ջ": "j", "ռ": "rr", "ս": "s", "վ": "v", "տ": "t", "ր": "r", "ց": "ts",
    "ւ": "v", "փ": "p", "ք": "k", "օ": "o", "ֆ": "f", "և": "ev",
}
GEORGIAN = {
    "ა": "a", "ბ": "b", "გ": "g", "დ": "d", "ე": "e", "ვ": "v", "ზ": "z", "თ": "t", "ი": "i", "კ": "k", "ლ": "l",
    "მ": "m", "ნ": "n", "ო": "o", "პ": "p", "ჟ": "zh", "რ": "r", "ს": "s", "ტ": "t", "უ": "u", "ფ": "p", "ქ": "k",
    "ღ": "gh", "ყ": "q", "შ": "sh", "ჩ": "ch", "ც": "ts", "ძ": "dz", "წ": "ts", "ჭ": "ch", "ხ": "kh", "ჯ": "j", "ჰ": "h",
}
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t",
    "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph",
    "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "ss", "स": "s", "ह": "h",
    "ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ं": "n",
    "ः": "h", "ँ": "n",
}
SILENT = {"\u094d": "", "\u093c": "", "\u0640": "", "\u200c": "", "\u200d": ""}  # virama, nukta, tatweel, joiners
HANGUL_LEADS = "g kk n d tt r m b pp s ss - j jj ch k t p h".split()
HANGUL_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
HANGUL_TAILS = "- g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h".split()
KANA_ROWS = {  # first code point of a row of five sounds, by the sounds' spelling; small and voiced forms are listed apart
    0x304B: "ka ga ki gi ku gu ke ge ko go", 0x3055: "sa za shi ji su zu se ze so zo",
    0x305F: "ta da chi ji - tsu zu te de to do", 0x306A: "na ni nu ne no",
    0x306F: "ha ba pa hi bi pi fu bu pu he be pe ho bo po", 0x307E: "ma mi mu me mo",
    0x3041: "a a i i u u e e o o", 0x3083: "ya ya yu yu yo yo", 0x3089: "ra ri ru re ro", 0x308F: "wa wi we wo n vu",
}
PUNCTUATION = {
    "\u00a0": " ", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "--", "\u2018": "'",
    "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "...", "\u3000": " ",
}
# Code point ranges of accented letters that decompose to a base letter.
DECOMPOSED_RANGES = [(0x00C0, 0x024F), (0x0386, 0x03CE), (0x1E00, 0x1EFF)]


@lru_cache(maxsize=1)
def letter_table() -> dict[str, str]:
    """Non-ASCII letter -> ASCII text, assembled from the fixed letters and the decomposition rule."""
    table: dict[str, str] = {}
    for lower in (CYRILLIC_LOWER, GREEK_LOWER, ARMENIAN_LOWER):
        for letter, text in lower.items():
            table[letter] = text
            if len(letter.upper()) == 1 and letter.upper() != letter and letter != "ς":
                table[letter.upper()] = text[:1].upper() + text[1:]
    for fixed in (LATIN_OTHER, ARABIC, HEBREW, GEORGIAN, DEVANAGARI, PUNCTUATION):
        table.update(fixed)
    for first, sounds in KANA_ROWS.items():
        for k, sound in enumerate(sounds.split()):
            # Katakana stands 0x60 above hiragana. The small tsu doubles what follows; it is left out.
            table[chr(first + k)] = table[chr(first + k + 0x60)] = "" if sound == "-" else sound
    table.update(SILENT)
    for low, high in DECOMPOSED_RANGES:
        for letter in map(chr, range(low, high + 1)):
            base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
            if letter not in table and base and base != letter:
                text = "".join(c if c.isascii() else table.get(c, "") for c in base)
                if text:
                    table[letter] = text
    return table


def _hangul(c: Column) -> Column:
    """A Hangul syllable as lead, vowel and tail; the code point tells which."""
    place = F.ascii(c) - 0xAC00

    def part(names: list[str], index: Column) -> Column:
        return F.get(F.split(F.lit(" ".join(names).replace("-", "")), " "), index.cast("int"))

    return F.concat(part(HANGUL_LEADS, place / 588), part(HANGUL_VOWELS, (place % 588) / 28), part(HANGUL_TAILS, place % 28))


def _is_hangul(c: Column) -> Column:
    return (c >= F.lit("\uac00")) & (c <= F.lit("\ud7a3"))


def literal_map(pairs: dict[str, str]) -> Column:
    """A text map as one constant, which the optimizer folds; far smaller in a plan than a map of single literals."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def transliterate(value: Column, extra: dict[str, str] | None = None) -> Column:
    """ASCII form of ``value``. Pure ASCII input (nearly all rows) skips the mapping work."""
    table = {**letter_table(), **(extra or {})}
    one = {k: v for k, v in table.items() if len(v) == 1}
    many = {k: v for k, v in table.items() if len(v) != 1}
    single = F.translate(value, "".join(one), "".join(one.values()))
    spelled = F.array_join(
        F.transform(
            F.split(single, ""),
            lambda c: F.when(c <= F.lit("\x7f"), c)
            .when(_is_hangul(c), _hangul(c))
            .otherwise(F.coalesce(literal_map(many)[c], F.lit(""))),
        ),
        "",
    )
    return F.when(_is_ascii(value), value).otherwise(spelled)


def _is_ascii(value: Column) -> Column:
    # Equal byte and character counts: cheaper than a regular expression over the text.
    return F.octet_length(value) == F.length(value)


def was_transliterated(value: Column) -> Column:
    """True when romanisation changes the text, which is exactly when it holds a non-ASCII character."""
    return ~_is_ascii(value)


def dropped_letters(value: Column, extra: dict[str, str] | None = None) -> Column:
    """How many characters romanisation leaves out because no table has them; 0 for null."""
    known = F.translate(value, "".join({**letter_table(), **(extra or {})}), "")
    left = F.filter(F.split(known, ""), lambda c: (c > F.lit("\x7f")) & ~_is_hangul(c))
    return F.when(F.coalesce(_is_ascii(value), F.lit(True)), 0).otherwise(F.size(left)).cast("int")

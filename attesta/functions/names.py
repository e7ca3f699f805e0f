"""Name preparation: Unicode form, accents, titles, tokens, aliases, transliteration."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that don't belong to a name (lower case, without dots).
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "dame", "lord", "lady", "rev", "hon", "sr", "sra", "srta", "don", "dona", "lic", "ing", "m", "mme", "mlle", "herr", "frau")
#: Latin letters with marks and what they become.
ACCENTED, PLAIN = "áàâäãåāăąçćčďđéèêëēęěğíìîïīłñńňóòôöõøōőřśšşťúùûüūůűýÿźžż", "aaaaaaaaacccddeeeeeeegiiiiilnnnooooooooorssstuuuuuuuyyzzz"
#: Published letter tables; a letter that is missing stays as it is.
LETTERS = {
    "iso233": {
        "ا": "ʾ", "ب": "b", "ت": "t", "ث": "ṯ", "ج": "ǧ", "ح": "ḥ", "خ": "ẖ", "د": "d", "ذ": "ḏ", "ر": "r", "ز": "z", "س": "s", "ش": "š", "ص": "ṣ",
        "ض": "ḍ", "ط": "ṭ", "ظ": "ẓ", "ع": "ʿ", "غ": "ġ", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
    },
    "ala-lc": {
        "ا": "ā", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "ḥ", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "ṣ",
        "ض": "ḍ", "ط": "ṭ", "ظ": "ẓ", "ع": "ʻ", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y",
    },
    "bgn": {
        "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
        "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "”", "ы": "y", "ь": "’", "э": "e", "ю": "yu", "я": "ya",
    },
}


def nfc(s: Column) -> Column:
    """Unicode form C; no built-in does it."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return of(s)


def strip_marks(s: Column) -> Column:
    """Any alphabet: combining marks removed after decomposition."""

    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return of(s)


def strip_accents(s: Column) -> Column:
    """Lower-case Latin letters without their marks, in the JVM; other letters stay."""
    return F.translate(s, ACCENTED, PLAIN)


def strip_titles(s: Column, titles: Sequence[str] = TITLES) -> Column:
    """Titles at the beginning of a lower-case name removed, with their dots."""
    return F.regexp_replace(s, rf"^(?:(?:{'|'.join(titles)})\.?\s+)+", "")


def normalized(s: Column) -> Column:
    """Lower case, marks and titles removed, white space single. Null stays null."""
    return F.trim(F.regexp_replace(strip_titles(strip_accents(F.lower(F.trim(s)))), r"\s+", " "))


def tokens(s: Column) -> Column:
    """Parts of a name between spaces, hyphens and commas."""
    return F.filter(F.split(s, r"[\s,\-]+"), lambda x: x != "")


def aliases(s: Column) -> Column:
    """Comma-separated aliases as an array, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def needs_transliteration(s: Column) -> Column:
    """Whether a name has letters outside the Latin alphabet."""
    return s.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def transliterated(s: Column, table: str) -> Column:
    """Letters replaced by one of LETTERS: single letters by one translate, longer values by replacements."""
    letters = LETTERS[table]
    single = {k: v for k, v in letters.items() if len(v) == 1}
    out = F.translate(s, "".join(single), "".join(single.values()))
    for k, v in letters.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out

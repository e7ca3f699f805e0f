"""Phonetic keys from published rules: Soundex is built in; Metaphone and NYSIIS are not."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings that Metaphone reads otherwise.
METAPHONE_FIRST = [("THOMPS", "TOMS"), ("THOM", "TOM"), ("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("WH", "W"), ("X", "S")]
#: NYSIIS rules for the beginning, the end, and the inside of a name.
NYSIIS_FIRST = [("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")]
NYSIIS_LAST = [("EE", "Y"), ("IE", "Y"), ("DT", "D"), ("RT", "D"), ("RD", "D"), ("NT", "D"), ("ND", "D")]
NYSIIS_INSIDE = [("EV", "AF"), ("Q", "G"), ("Z", "S"), ("M", "N"), ("KN", "NN"), ("K", "C"), ("SCH", "SSS"), ("PH", "FF")]


def letters(name: str) -> str:
    return re.sub(r"[^A-Z]", "", name.upper())


def metaphone_key(name: str) -> str:
    """The sounds of a name's consonants, and of a vowel at its beginning; each letter is read by its neighbours in the name. 0 is th, X is sh."""
    s = letters(name)
    s = next((b + s[len(a) :] for a, b in METAPHONE_FIRST if s.startswith(a)), s)
    s = re.sub(r"([ABD-Z])\1+", r"\1", s)  # double letters but C sound once
    key = []
    for i, c in enumerate(s):
        before, after, rest = s[i - 1 : i], s[i + 1 : i + 2], s[i:]
        vowel, soft = after in set("AEIOU"), after in set("EIY")
        if c in "AEIOU":
            sound = c if i == 0 else ""
        elif c == "B":
            sound = "" if before == "M" and not after else "B"
        elif c == "C":
            if rest.startswith("CIA") or (after == "H" and before != "S"):
                sound = "X"
            elif soft:
                sound = "" if before == "S" else "S"
            else:
                sound = "K"
        elif c == "D":
            sound = "J" if re.match("DG[EIY]", rest) else "T"
        elif c == "G":
            silent = (after == "H" and rest[2:3] not in set("AEIOU")) or rest in ("GN", "GNED") or (before == "D" and soft)
            sound = "" if silent else "J" if soft else "K"
        elif c == "H":
            sound = "H" if vowel and before not in set("CGPST") else ""
        elif c == "K":
            sound = "" if before == "C" else "K"
        elif c == "P":
            sound = "F" if after == "H" else "P"
        elif c == "S":
            sound = "X" if after == "H" or re.match("SI[AO]", rest) else "S"
        elif c == "T":
            sound = "X" if re.match("TI[AO]", rest) else "0" if after == "H" else "" if rest.startswith("TCH") else "T"
        elif c in "WY":
            sound = c if vowel else ""
        else:
            sound = {"Q": "K", "V": "F", "X": "KS", "Z": "S"}.get(c, c)
        key.append(sound)
    return "".join(key)


def nysiis_key(name: str) -> str:
    s = letters(name)
    if not s:
        return ""
    for a, b in NYSIIS_FIRST:
        if s.startswith(a):
            s = b + s[len(a) :]
            break
    for a, b in NYSIIS_LAST:
        if s.endswith(a):
            s = s[: -len(a)] + b
            break
    key, i = s[0], 1
    while i < len(s):
        rule = next(((a, b) for a, b in NYSIIS_INSIDE if s.startswith(a, i)), None)
        if rule:
            part, i = rule[1], i + len(rule[0])
        else:
            c = s[i]
            if c in "AEIOU":
                c = "A"
            elif c == "H" and (s[i - 1] not in "AEIOU" or i + 1 == len(s) or s[i + 1] not in "AEIOU"):
                c = "A" if s[i - 1] in "AEIOU" else s[i - 1]
            elif c == "W" and s[i - 1] in "AEIOU":
                c = "A"
            part, i = c, i + 1
        for c in part:
            if c != key[-1]:
                key += c
    if len(key) > 1:
        key = re.sub(r"S$", "", key)
        key = re.sub(r"AY$", "Y", key)
        key = re.sub(r"(?<=.)A$", "", key)
    return key


def keyed(name: Column, key: Callable[[str], str]) -> Column:
    """A key of each name; null stays null."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else key(x))

    return of(name)


def metaphone(name: Column) -> Column:
    return keyed(name, metaphone_key)


def nysiis(name: Column) -> Column:
    return keyed(name, nysiis_key)


def variants(name: Column) -> Column:
    """array<struct<kind, key>>: the phonetic keys of a name."""
    kinds = {"soundex": F.soundex(name), "metaphone": metaphone(name), "nysiis": nysiis(name)}
    return F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()))

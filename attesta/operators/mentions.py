"""Mentions of listed names in texts, and aliases that a text states itself.

One pass of an Aho-Corasick automaton over a text finds all names at once, however many there are. The automaton is
made from a bounded part of the list: a list beyond the bound is dealt by its names' first letters into shards, each
small enough to hand to every task, and texts are read once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of names in one automaton: about 1 GB of memory for a worker at 20 million letters; this takes a tenth.
LETTERS = 2_000_000
#: How texts say that somebody has another name.
STATED = r"also known as|a\.k\.a\.|aka|alias"
_NAME = r"(?:\"([^\"\n]{1,80})\"|([\p{Lu}\p{N}][\p{L}\p{N}.'#_-]*(?: [\p{Lu}\p{N}][\p{L}\p{N}.'#_-]*){0,3}))"


def automaton(names: list[str]):
    """An Aho-Corasick automaton of lower-cased names."""
    import ahocorasick  # an optional package of the workers

    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def found(made, text: str) -> Iterator[tuple[int, str]]:
    """(start, name) of whole-word mentions: no letter or digit beside it, unless the name itself ends in something else there."""
    word = lambda c: c.isalnum()
    for last, name in made.iter(text):
        start = last - len(name) + 1
        if start and word(text[start - 1]) and word(name[0]) or last + 1 < len(text) and word(text[last + 1]) and word(name[-1]):
            continue
        yield start, name


def lowered(c: Column) -> Column:
    """Text in lower case, character by character, so that positions stay: letters whose lower case is longer are left as they are."""
    return F.replace(F.lower(F.replace(c, F.lit("\u0130"), F.lit("\ue000"))), F.lit("\ue000"), F.lit("\u0130"))


def shards(names: DataFrame, name: str, letters: int = LETTERS) -> list[list[str]]:
    """The list's different names in lower case, in groups of at most `letters` letters (or one name), whole first letters where they fit."""
    low = names.select(F.trim(lowered(F.col(name))).alias("name")).where("name <> ''").distinct()
    sizes = low.groupBy(F.substring("name", 1, 1).alias("first")).agg(F.sum(F.length("name")).alias("n")).orderBy("first").collect()
    parts: list[tuple[list[str], int, int]] = []  # letters, number of parts, letters of names
    for first, n in sizes:
        if parts and parts[-1][1] == 1 and parts[-1][2] + n <= letters:
            parts[-1] = ([*parts[-1][0], first], 1, parts[-1][2] + n)
        else:
            parts.append(([first], -(-2 * n // letters) if n > letters else 1, n))
    out = []
    for firsts, count, _ in parts:
        own = low.where(F.substring("name", 1, 1).isin(firsts))
        out += [[r.name for r in own.where(F.pmod(F.xxhash64("name"), F.lit(count)) == k).collect()] for k in range(count)]
    return out


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, letters: int = LETTERS) -> DataFrame:
    """(key, name, start) of every whole-word mention of a listed name in either case; start counts characters from 1.

    Null texts have none, names are trimmed and empty ones left out, repeated names count once, repeated texts each.
    No shuffle: every task finds the mentions in its own texts.
    """
    kind = texts.schema[key].dataType.simpleString()
    slim, parts = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), lowered(F.col(text)).alias("text")), []
    for some in shards(names, name, letters):
        if not some:
            continue
        told = texts.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pd.DataFrame], told=told) -> Iterator[pd.DataFrame]:
            made = automaton(told.value)
            for batch in batches:
                rows = [(i, at + 1, said) for i, t in enumerate(batch["text"]) for at, said in found(made, t)]
                out = pd.DataFrame(rows, columns=["i", "start", "name"])
                yield pd.DataFrame({"key": batch["key"].iloc[out["i"].astype(int)].to_numpy() if len(out) else batch["key"].iloc[:0], "name": out["name"], "start": out["start"]})

        parts.append(slim.mapInPandas(run, f"key {kind}, name string, start int"))
    if not parts:
        return slim.select("key", F.lit("").alias("name"), F.lit(0).alias("start")).limit(0).withColumnRenamed("key", key)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumnRenamed("key", key)


def stated_aliases(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, alias): what a text itself calls another name of somebody: a name, a phrase of STATED, and a name, each in quotes or up to four capitalised words."""
    pattern = rf"{_NAME},? ?\(?(?:{STATED}):? {_NAME}"
    said = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    each = texts.select(F.col(key), F.explode(said).alias("said"))
    one = lambda n: F.coalesce(F.nullif(F.regexp_extract("said", pattern, n), F.lit("")), F.regexp_extract("said", pattern, n + 1))
    return each.select(key, one(1).alias("name"), one(3).alias("alias"))

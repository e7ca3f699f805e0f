"""Timelines: unified events, gaps, sessions, rhythm, and how a narrative changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unified(*parts: tuple[DataFrame, str, Column, Column, Column]) -> DataFrame:
    """(entity, ts, source, event_type) of all parts, each (rows, source, entity, ts, event type)."""
    each = [df.select(entity.cast("string").alias("entity"), ts.cast("timestamp_ntz").alias("ts"), F.lit(source).alias("source"), kind.alias("event_type")) for df, source, entity, ts, kind in parts]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def gaps(df: DataFrame, who: str, ts: str, tie: str, least_seconds: int) -> DataFrame:
    """Events of each entity that come `least_seconds` or more after the one before, with the gap."""
    before = F.lag(ts).over(Window.partitionBy(who).orderBy(ts, tie))
    gap = F.timestamp_diff("SECOND", before, F.col(ts))
    return df.withColumn("gap_seconds", gap).where(F.col("gap_seconds") >= least_seconds)


def sessions(df: DataFrame, who: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Activity windows: session start, end of the last event, and number of events."""
    return df.groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events")).drop("w")


def rhythm(df: DataFrame, who: str, ts: str, tie: str) -> DataFrame:
    """Mean and standard deviation of seconds between events, by entity; few entities have only one event and then none."""
    before = F.lag(ts).over(Window.partitionBy(who).orderBy(ts, tie))
    step = df.withColumn("step", F.timestamp_diff("SECOND", before, F.col(ts)))
    return step.groupBy(who).agg(F.count("step").alias("steps"), F.round(F.avg("step"), 2).alias("mean_seconds"), F.round(F.stddev_samp("step"), 2).alias("sd_seconds"))


def hours(df: DataFrame, ts: str) -> DataFrame:
    """Events by weekday (Monday is 0) and hour."""
    return df.groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def narrative(df: DataFrame, turn: str, text: str, least: int = 2) -> DataFrame:
    """(turn, token, n, change): token counts by turn and their change from the turn before, of tokens met `least` times."""
    each = df.select(turn, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    counts = each.groupBy(turn, "token").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select((F.col(turn) + 1).alias(turn), "token", F.col("n").alias("_n"))
    return counts.join(before, [turn, "token"], "left").where(F.col("n") >= least).select(turn, "token", "n", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("change"))


def vanished(df: DataFrame, turn: str, text: str, least: int = 2) -> DataFrame:
    """(turn, token, n, change): tokens met `least` times in the turn before and not at all in this one, of turns that have tokens."""
    each = df.select(turn, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    counts = each.groupBy(turn, "token").agg(F.count(F.lit(1)).alias("n"))
    before = counts.where(F.col("n") >= least).select((F.col(turn) + 1).alias(turn), "token", F.col("n").alias("_n"))
    gone = before.join(counts.select(turn).distinct(), turn, "left_semi").join(counts.select(turn, "token"), [turn, "token"], "left_anti")
    return gone.select(turn, "token", F.lit(0).cast("bigint").alias("n"), (-F.col("_n")).alias("change"))


def shared_lines(df: DataFrame, key: str, text: str, least_length: int = 20) -> DataFrame:
    """Lines that more than one text has: digest, texts, and length. Only digests are shuffled."""
    lines = df.select(key, F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where(F.length("line") >= least_length)
    return lines.select(key, F.sha2("line", 256).alias("line_sha256"), F.length("line").alias("length")).groupBy("line_sha256", "length").agg(F.count_distinct(key).alias("texts")).where("texts > 1")


def correlated(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Pearson correlation of two measures in each group, to 6 decimals; null where one doesn't vary."""
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(by).agg(F.round(value, 6).alias("correlation"), F.count(F.lit(1)).alias("n"))


def rayleigh(df: DataFrame, who: str, ts: str, periods: list[int]) -> DataFrame:
    """(who, period_seconds, n, power, p_value): the period of `periods` (seconds) on which each entity's events gather most.

    Power is n R², R the length of the mean of the events' directions on a clock of that period (Rayleigh's test); the
    p-value is the chance of as much by events at any time. Ties (to 9 decimals) go to the shortest period; with one
    event every period has power 1. Events without time or entity are left out. One pass: two sums for each period.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    angle = {p: F.pmod(micros, F.lit(p * 1_000_000)) / (p * 1_000_000) * F.lit(2 * 3.141592653589793) for p in periods}
    sums = [x for p in periods for x in (F.sum(F.cos(angle[p])).alias(f"c{p}"), F.sum(F.sin(angle[p])).alias(f"s{p}"))]
    each = df.where(F.col(who).isNotNull() & F.col(ts).isNotNull()).groupBy(who).agg(F.count(F.lit(1)).alias("n"), *sums)
    n = F.col("n")
    power = lambda p: F.round((F.pow(F.col(f"c{p}"), 2) + F.pow(F.col(f"s{p}"), 2)) / n, 9)
    best = F.greatest(*(F.struct(power(p).alias("power"), F.lit(-p).alias("less")) for p in periods)) if len(periods) > 1 else F.struct(power(periods[0]).alias("power"), F.lit(-periods[0]).alias("less"))
    z = F.col("best.power")
    chance = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - n * z)) - (1 + 2 * n))
    return each.withColumn("best", best).select(who, (-F.col("best.less")).cast("int").alias("period_seconds"), "n", F.round(z, 6).alias("power"), F.round(F.least(chance, F.lit(1.0)), 6).alias("p_value"))


def bursts(df: DataFrame, turn: str, text: str, least: int = 10, factor: float = 2.0, price: float = 1.0) -> DataFrame:
    """(token, first_turn, last_turn, n): stretches of turns in which a token, met `least` times or more, is told far more often than elsewhere.

    Kleinberg's automaton of two states: a token comes at its overall rate, or at `factor` times that. Going up costs
    `price` times the logarithm of the number of turns, going down nothing; the cheapest sequence of states (Viterbi,
    ties to the lower state or to staying) is found by a fold over each token's turns. There are as many as the longest
    text has turns; one array of their totals goes to every token. Rows without a turn are left out.
    """
    each = df.where(F.col(turn).isNotNull()).select(F.col(turn).alias("turn"), F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")
    counts = each.groupBy("token", "turn").agg(F.count(F.lit(1)).alias("r"))
    totals = counts.groupBy("turn").agg(F.sum("r").alias("d")).agg(F.array_sort(F.collect_list(F.struct("turn", "d"))).alias("turns"), F.sum("d").alias("all"))
    tokens = counts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("turn", "r"))).alias("by"), F.sum("r").alias("sum")).where(F.col("sum") >= least)
    both = tokens.join(F.broadcast(totals)).withColumn("p0", F.col("sum") / F.col("all")).withColumns({"p1": F.least(F.col("p0") * factor, F.lit(0.9999)), "up": price * F.log(F.size("turns").cast("double"))})
    r = lambda x: F.coalesce(F.try_element_at("by", x["turn"]), F.lit(0).cast("bigint"))
    cost = lambda x, p: -(r(x) * F.log(F.col(p)) + (x["d"] - r(x)) * F.log(1 - F.col(p)))
    start = F.struct(F.lit(0.0).alias("c0"), F.lit(1e300).alias("c1"), F.lit("").alias("s0"), F.lit("").alias("s1"))

    def step(a: Column, x: Column) -> Column:
        low = F.when(a["c0"] <= a["c1"], a["s0"]).otherwise(a["s1"])
        high = F.when(a["c1"] <= a["c0"] + F.col("up"), a["s1"]).otherwise(a["s0"])
        return F.struct((F.least(a["c0"], a["c1"]) + cost(x, "p0")).alias("c0"), (F.least(a["c0"] + F.col("up"), a["c1"]) + cost(x, "p1")).alias("c1"), F.concat(low, F.lit("0")).alias("s0"), F.concat(high, F.lit("1")).alias("s1"))

    path = F.aggregate("turns", start, step, lambda a: F.when(a["c0"] <= a["c1"], a["s0"]).otherwise(a["s1"]))
    states = both.select("token", "by", "turns", path.alias("path"))
    at = states.select("token", F.posexplode("turns").alias("k", "x"), "path", "by").where(F.expr("substring(path, k + 1, 1) = '1'"))
    run = F.col("k") - F.row_number().over(Window.partitionBy("token").orderBy("k"))
    return at.withColumn("_run", run).groupBy("token", "_run").agg(F.min("x.turn").alias("first_turn"), F.max("x.turn").alias("last_turn"), F.sum(r(F.col("x"))).alias("n")).drop("_run")


def distinctive(df: DataFrame, key: str, by: str, text: str, least: int = 5, top: int = 50) -> DataFrame:
    """(by, term, texts, llr): the `top` terms that each group's texts have more often than the others', by Dunning's log-likelihood ratio.

    A term counts once in a text and must be in `least` texts or more; ties of the ratio (to 6 decimals) go to the lesser
    term. Texts without a group are left out. Keys are unique. A group's terms are ranked in 64 parts first.
    """
    own = df.where(F.col(by).isNotNull())
    terms = own.select(F.col(by), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("term")).where("term <> ''")
    counts = terms.groupBy(by, "term").agg(F.count(F.lit(1)).alias("texts"))
    groups = own.groupBy(by).agg(F.count(F.lit(1)).alias("docs"))
    has = counts.groupBy("term").agg(F.sum("texts").alias("has")).where(F.col("has") >= least)
    n = groups.agg(F.sum("docs").alias("n"))
    x = counts.join(has, "term").join(groups, by).join(F.broadcast(n))
    a, docs, every = F.col("texts").cast("double"), F.col("docs").cast("double"), F.col("n").cast("double")
    b, c = F.col("has") - a, docs - a
    d = every - docs - F.col("has") + a
    part = lambda v, row, column: F.when(v > 0, v * F.log(v * every / (row * column))).otherwise(0.0)
    llr = F.round(2 * (part(a, a + b, a + c) + part(b, a + b, b + d) + part(c, c + d, a + c) + part(d, c + d, b + d)), 6)
    more = x.where(a * every > (a + b) * (a + c)).select(by, "term", "texts", llr.alias("llr"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("_part"))
    first = lambda t, *w: t.withColumn("_i", F.row_number().over(Window.partitionBy(*w).orderBy(F.desc("llr"), "term"))).where(F.col("_i") <= top)
    return first(first(more, by, "_part"), by).select(by, "term", "texts", "llr")

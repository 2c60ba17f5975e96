"""Secrets by fixed patterns and by a battery of randomness tests.  Everything is a DataFrame operation.

The patterns give the base spans.  Other long runs of key-like characters are candidates.  A candidate's encoding is
inferred from its characters, as the tightest alphabet that holds them.  The battery has three tests: chi-squared of the alphabet's
uniformity, the number of runs, and serial correlation.  Each is asked twice.  That the token is random under its encoding must
not be rejected by any (the limit of chi-squared grows with the length, since the key's own alphabet may be smaller still).
That it is text (letters as often as in words, few changes of character class, codes that follow their neighbours') gives a
p-value from each; Fisher's method combines the three, and a Benjamini-Hochberg step over all candidates of like length controls
the share of false discoveries.  P-values are rounded up to a grid, so that the step needs only counts by length and grid point.
Random letters of one case alone are no more than text to these tests and are not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm import common

#: The kinds in order, their patterns (group 0 is the span), the group that is measured, and its least length.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # the whole run, which has 16 characters or more
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Share of false discoveries, and how improbable a random string must be to fail a randomness test (deviations).
FALSE_SHARE, LEAST_FIT = 0.05, 4.0
#: What an alphabet that lacks an eighth of the inferred symbols (as base58 or Crockford's base32) adds to chi-squared, a character.
LACKING = 1 / 7
#: Encodings, the tightest first, as (pattern, symbols); those of one case are shown in lower case.
_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_BOTH = _LOWER.upper() + _LOWER
ENCODINGS = [
    ("[0-9]+", _DIGITS),
    ("[0-9a-f]+|[0-9A-F]+", _DIGITS + "abcdef"),
    ("[a-z]+|[A-Z]+", _LOWER),
    ("[a-z2-7]+|[A-Z2-7]+", _LOWER + "234567"),
    ("[a-z0-9]+|[A-Z0-9]+", _LOWER + _DIGITS),
    ("[A-Za-z]+", _BOTH),
    ("[A-Za-z0-9]+", _BOTH + _DIGITS),
    ("[A-Za-z0-9+/]+", _BOTH + _DIGITS + "+/"),
    ("[A-Za-z0-9_-]+", _BOTH + _DIGITS + "-_"),
]
_ALL, ONE_CASE = _BOTH + _DIGITS + "+/-_", 36
#: Under text: the probability that two letters are equal, that three are, that neighbours differ in class, and the serial correlation of codes
#: of several classes.
PAIR, TRIPLE, CHANGE, SERIAL = 0.066, 0.0055, 0.1, 0.4
GRID = 4


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, kind: int) -> Column:
    """array<struct(s, k, e)> of one kind: the matches and what stands between them give the places, in code points."""
    _, pattern, group, least = KINDS[kind]
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("held"))
    found = let(parts, lambda x: places(x, kind, lambda held: F.length(held) >= least))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def places(x: Column, kind: int, keep) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc, i):
        s = acc["at"] + F.length(F.get(x["gaps"], i))
        e = s + F.length(F.get(x["hits"], i))
        span = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(keep(F.get(x["held"], i)), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(x["hits"]) == 0, zero["out"]).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), zero, step)["out"])


def fisher(*z: Column) -> Column:
    """Minus the decimal logarithm of the p-value that combines those of three normal deviations; all are rounded up."""
    # Sampford's bound of the normal tail; below 0 it is taken as 1
    one = lambda x: F.when(x > 0, x * x / 2 + F.ln((3 * x + F.sqrt(x * x + 8)) * (2.506629 / 4))).otherwise(0.0)
    total = F.aggregate(F.transform(F.array(*z), one), F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), x))
    return let(total, lambda y: (y - F.ln(1 + y + y * y / 2)) / 2.302586)  # the tail of chi-squared with six degrees


def battery(token: Column) -> Column:
    """struct(fits, log10): whether the tests let the token pass as random, and minus the logarithm of the p-value that it is text."""
    core = F.regexp_replace(token, "[=]+$", "")

    def tests(x):
        t, k = x["t"], x["k"].cast("double")
        m = F.length(t).cast("double")
        codes = x["codes"]
        counts = F.transform(F.array_distinct(F.split(t, "")), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        uniform = (k / m * squares - m - (k - 1)) / F.sqrt(2 * (k - 1))
        high = F.transform(codes, lambda c: (c > (k + 1) / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda a, c: a + c).cast("double")
        n2 = m - n1
        steps = F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: (a != b).cast("int"))
        runs = F.aggregate(steps, F.lit(1), lambda a, c: a + c).cast("double")
        expected = 2 * n1 * n2 / m + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), 2 * n1 * n2 * (2 * n1 * n2 - m) / (m * m * (m - 1))))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / m
        away = let(mean, lambda held: F.transform(codes, lambda c: c - held))
        own = F.aggregate(away, F.lit(1e-9), lambda a, c: a + c * c)
        cross = F.aggregate(F.zip_with(F.slice(away, 1, F.size(away) - 1), F.slice(away, 2, F.size(away) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
        serial = cross / own * F.sqrt(m)
        # of an alphabet that lacks symbols, mean and variance grow with the length
        more = LACKING * m
        limit = (more + LEAST_FIT * F.sqrt(2 * (k - 1) + 4 * more)) / F.sqrt(2 * (k - 1))
        fits = (uniform < limit) & (F.abs((runs - expected) / spread) < LEAST_FIT) & (F.abs(serial) < LEAST_FIT)
        text_squares = m + m * (m - 1) * PAIR
        text_spread = F.sqrt(4 * m * m * m * (TRIPLE - PAIR * PAIR) + 2 * m * m * PAIR * (1 - PAIR))
        smooth = (text_squares - squares) / text_spread
        kinds = F.translate(x["raw"], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", "A" * 26 + "a" * 26 + "0" * 10)
        # marks between words go, and a capital that begins a word is of the word's class
        changes = F.length(F.regexp_replace(F.regexp_replace(kinds, "Aa", "aa"), r"(.)\1*", "x")).cast("double") - 1
        busy = (changes - CHANGE * (m - 1)) / F.sqrt(CHANGE * (1 - CHANGE) * (m - 1))
        # one class of characters is in no order under either hypothesis
        unordered = F.when(changes > 0, (SERIAL - cross / own) * F.sqrt(m)).otherwise(0.0)
        return F.struct(fits.alias("fits"), fisher(smooth, busy, unordered).alias("log10"))

    # each step is bound, so that no character repeats it
    def named(core):
        found = F.coalesce(*[F.when(F.regexp_like(core, F.lit(f"^({pattern})$")), F.lit(symbols)) for pattern, symbols in ENCODINGS], F.lit(_ALL))
        return F.struct(core.alias("raw"), found.alias("alphabet"))

    def coded(x):
        k = F.length(x["alphabet"])
        shown = F.when(k <= ONE_CASE, F.lower(x["raw"])).otherwise(x["raw"])
        codes = lambda t: F.transform(F.split(t, ""), lambda c: F.instr(x["alphabet"], c).cast("double"))
        return let(shown, lambda t: F.struct(t.alias("t"), x["raw"].alias("raw"), k.alias("k"), codes(t).alias("codes")))

    judged = let(core, lambda c: let(named(c), lambda x: let(coded(x), tests)))
    return F.when(F.length(core) >= 16, judged).otherwise(F.struct(F.lit(False).alias("fits"), F.lit(0.0).alias("log10")))


def candidates(text: Column, base: Column) -> Column:
    """array<struct(s, e, length, grid)> of runs that no base span meets and that pass the randomness tests or have a grid of 0."""
    parts = F.struct(F.split(text, CANDIDATE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"))
    held = let(parts, lambda x: F.struct(x["gaps"].alias("gaps"), x["hits"].alias("hits"), x["hits"].alias("held")))
    found = let(held, lambda x: places(x, len(KINDS), lambda t: F.lit(True)))
    free = F.filter(found, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def judge(c):
        token = F.substring(text, c["s"] + 1, c["e"] - c["s"])

        def grid(t):  # steps of log10
            log10 = F.when(t["fits"], t["log10"]).otherwise(0.0)
            return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.floor(F.log2((c["e"] - c["s"]).cast("double"))).cast("int").alias("length"), F.least(F.lit(400), F.floor(log10 * GRID)).cast("int").alias("grid"))

        return let(battery(token), grid)

    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), F.transform(free, judge)).otherwise(F.array().cast("array<struct<s:int,e:int,length:int,grid:int>>"))


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, base, found): spans struct(s, k, e) of each row's whole text, k = 3 for those that the tests add.

    A null or empty text has no spans; very long texts are scanned whole; repeated rows get equal answers (each counts in the
    false-discovery step); an empty table gives no rows.
    """
    rows = common.texts(docs).withColumn("a", spans(F.col("text"), 0)).withColumn("b", spans(F.col("text"), 1)).withColumn("c", spans(F.col("text"), 2))
    rows = rows.select("doc_id", "text", F.explode(F.array(F.array_sort(F.concat("a", "b", "c")))).alias("base"))  # computed once
    rows = common.materialize(rows.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("more")), "spans")
    counts = rows.select(F.explode("more").alias("m")).groupBy("m.length", "m.grid").agg(F.count("*").alias("n"))
    down = W.partitionBy("length").orderBy(F.desc("grid"))
    ranked = counts.withColumn("upto", F.sum("n").over(down)).withColumn("all", F.sum("n").over(W.partitionBy("length")))
    least = ranked.where((F.col("grid") > 0) & (F.pow(F.lit(10.0), -F.col("grid") / GRID) <= false_share * F.col("upto") / F.col("all"))).groupBy("length").agg(F.min("grid").alias("grid"))
    least = least.agg(F.map_from_entries(F.collect_list(F.struct("length", "grid"))).alias("least"))  # one row, an entry for each power of two
    judged = rows.crossJoin(F.broadcast(least))
    passed = F.filter("more", lambda m: m["grid"] >= F.coalesce(F.try_element_at("least", m["length"]), F.lit(1000)))
    return judged.select("doc_id", "base", F.transform(passed, lambda m: F.struct(m["s"].alias("s"), F.lit(len(KINDS)).alias("k"), m["e"].alias("e"))).alias("found"))


def written(found: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """The base spans' numbers and digest, and all spans as text; nulls, repeated rows and empty tables as in ``scan``."""
    out = scan(common.table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "found")).alias("spans"))

"""Groups of spelling variants, by bands of letter parities.

A word's mask has a bit for each letter: whether it occurs an odd number of times.  One
letter put in or left out flips one bit, one replaced by another flips two.  Masks are
split into three bands, so words that are one edit apart agree in one band at least.  They
also agree in the first or the last half (rounded down) of the shorter word's length.  A word is
therefore filed under its band, one of its halves and the shorter word's length, its own or
one less; words that meet there are compared by what masks differ in, and what is left by the edit
itself.  Both conditions lose nothing, and both are part of the join, so that candidates
are not written.  A pair that meets in several places counts in the first only.  Places of more
than ``BLOCK`` words are dealt in parts over several tasks.

A word's form is the near word that occurs most often, if it occurs ``TIMES`` times as
often.  Forms become more frequent along a chain, so chains have no cycles and are at most
as long as the logarithm of the greatest number; roots are found by doubling.

Everything is DataFrame operations.  Texts are read once and give (word, count) by tasks
before anything is shuffled; no text is moved.

Cases: null and empty texts have no words.  A null id counts as the empty string.  Repeated
rows count as often as they occur.  Of several words that occur equally often the least
one, by code points, is the form.  Very long texts are taken whole.  An empty table gives
no rows.  Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 199  # runs whose checksum it divides lose a letter
LETTERS = 6  # code points of a word, at least
TIMES_SEEN = 5  # occurrences of a word, at least
TIMES = 5  # occurrences of a form, by those of the word
BLOCK = 2000  # words of one place that are compared by one task


def words(docs: DataFrame, every: int = EVERY, letters: int = LETTERS, seen: int = TIMES_SEEN) -> DataFrame:
    """(word, n) of all texts."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= letters)
    runs = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seen)


def masks(word: str) -> list[Column]:
    """Three bands of parities; letters are dealt in turn, so frequent ones are spread."""
    place = f"transform(split({word}, ''), c -> IF(ascii(c) < 128, ascii(c) - 97, ascii(c) - 192 + 26))"
    return [F.expr(f"aggregate(filter({place}, i -> i % 3 = {k}), 0, (m, i) -> m ^ shiftleft(1, i div 3))").alias(f"m{k}") for k in range(3)]


def filed(counted: DataFrame) -> DataFrame:
    """Words under (short, side, half, band, mask): up to twelve places each."""
    rows = counted.select("word", "n", F.length("word").alias("size"), *masks("word"))
    rows = rows.withColumn("short", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    half = F.floor(F.col("short") / 2).cast("int")
    head, tail = F.substring("word", F.lit(1), half), F.expr("right(word, cast(floor(short / 2) as int))")
    rows = rows.withColumn("head", head).withColumn("place", F.explode(F.array(F.struct(F.lit(0).alias("side"), head.alias("half")), F.struct(F.lit(1).alias("side"), tail.alias("half")))))
    rows = rows.select("*", F.posexplode(F.array("m0", "m1", "m2")).alias("band", "mask"))
    return rows.select("word", "n", "size", "short", "head", "m0", "m1", "m2", F.col("place.side").alias("side"), F.col("place.half").alias("half"), "band", "mask")


PLACE = ["short", "side", "half", "band", "mask"]


def near(counted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, na, b, nb): every pair of words one edit apart, once."""
    rows = cut(filed(counted))
    full = rows.groupBy(*PLACE).agg(F.count("*").alias("members")).where(F.col("members") > block)
    on = list(PLACE)
    left = right = rows
    if full.limit(1).count():
        full = cut(full)
        parts = F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int")
        dealt = rows.join(full, PLACE, "left").withColumn("parts", parts).drop("members")
        left = dealt.withColumn("part", F.pmod(F.hash("word"), F.col("parts"))).drop("parts")
        right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        on.append("part")
    l = left.select(*on, *[F.col(c).alias(f"l_{c}") for c in ("word", "n", "size", "head", "m0", "m1", "m2")])
    r = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in ("word", "n", "size", "head", "m0", "m1", "m2")])
    c = F.col
    flips = [F.bit_count(c(f"l_m{k}").bitwiseXOR(c(f"r_m{k}"))) for k in range(3)]
    # of two as long as each other the lesser comes left; else the shorter one
    order = (c("l_size") == c("x_short")) & ((c("r_size") > c("l_size")) | (c("l_word") < c("r_word")))
    first = ((c("x_side") == 0) | (c("l_head") != c("r_head"))) & ((c("x_band") == 0) | (flips[0] > 0)) & ((c("x_band") < 2) | (flips[1] > 0))
    edit = F.levenshtein(c("l_word"), c("r_word"), 1) == 1
    l = l.withColumn("x_short", c("short")).withColumn("x_side", c("side")).withColumn("x_band", c("band"))
    keys = l[on[0]] == r[on[0]]
    for k in on[1:]:
        keys = keys & (l[k] == r[k])
    pairs = l.join(r, keys & order & (flips[0] + flips[1] + flips[2] <= 2) & first & edit)
    return pairs.select(c("l_word").alias("a"), c("l_n").alias("na"), c("r_word").alias("b"), c("r_n").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: what is followed doubles each time."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def grouped(docs: DataFrame, times: int = TIMES, block: int = BLOCK, **reading) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    counted = cut(words(docs, **reading))
    pairs = near(counted, block)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = counted.join(best, "word", "left")
    good = -F.col("best.m") >= times * F.col("n")
    found = cut(found.select("word", F.when(good, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.m")).cast("long").alias("form_n")))
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

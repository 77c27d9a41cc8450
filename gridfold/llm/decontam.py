"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts and benchmark items become words: A-Z and other letters lower-cased, punctuation gone. In the template
of a text numbers, units after numbers, and names (capitalised words in mid-sentence) are typed placeholders,
so a question asked again with other numbers or names keeps its template. Every window of ``WINDOW`` template
words of an item is in the table, and every window of a text is looked up by its hash, which finds any
shared passage of ``WINDOW`` words wherever it stands, so also an item of which every fifth word is another. A match
gives an alignment of text and item; it counts if enough of the item's words agree along it, or along it and
those of neighbouring shifts, and every value of a placeholder in the item stands for one value in the text.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfold.llm.common import broadcast_if_small, checkpointed, table

WINDOW, LEAST_SHARE, LEAST_WORDS = 4, 0.6, 12
#: Words from which an item is looked for within texts; one of fewer must be a whole line or text.
WITHIN = 5
#: Alignments of a text that are cut from it in one row.
PLACES = 1024
#: Words in a row that are a leak by themselves, word for word.
LONG_RUN = 13
#: Largest number of benchmark windows, and of alignments, that is broadcast; beyond it the joins shuffle.
BROADCAST_WINDOWS = 500_000
#: Units that count as such after a number.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "cl", "l", "s", "sec", "secs", "second", "seconds", "min", "mins", "minute", "minutes", "h", "hr", "hrs", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres", "mile", "miles", "foot", "feet", "inch", "inches", "gram", "grams", "liter", "liters", "litre", "litres", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "gbp", "kmh", "mph", "hz", "w", "kw", "v", "pa", "c", "f", "k"]
#: Placeholders and the mark of a name: characters for private use, which no word holds after normalisation.
NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"
MARK, POINT, JOIN = "\ue000", "\ue004", "\ue005"
#: Characters between words: all but letters, digits and marks of any script.
BETWEEN = rf"[^\p{{L}}\p{{Nd}}\p{{M}}{MARK}{POINT}]+"
#: The same characters as a list that is faster to match, for texts that hold nothing outside ``PLAIN``.
PLAIN, PLAIN_BETWEEN = r"\x00-\u024F\u2000-\u206F", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u0080-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u00D7\u00F7\u2000-\u206F]+"
#: Decimal digits of other scripts, and the placeholders and marks, with what stands for them.
DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
FOREIGN = "".join(DIGITS) + NUMBER + UNIT + NAME + MARK + POINT + JOIN
NATIVE = "".join(str(unicodedata.decimal(c)) for c in DIGITS) + " " * 6


def _words(text: Column, between: str) -> Column:
    numbers = F.when(text.rlike("[0-9][.,][0-9]"), F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", POINT)).otherwise(text)
    marked = F.regexp_replace(numbers, r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll}0-9,;] )", " " + MARK)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(marked), between, " ")), F.lit(" "))
    return F.when(text.rlike("[0-9][A-Za-z]"), F.regexp_replace(words, f"(?<= )([0-9][0-9{POINT}]*)({'|'.join(UNITS)})(?= )", "$1 $2")).otherwise(words)


def word_string(text: Column) -> Column:
    """The words of a text, lower-cased, with one space on either side; names keep a mark in front.

    A point or comma between digits stays in the number, as a mark of its own; a unit that is glued to its
    number is a word of its own. Digits of other scripts become 0 to 9.
    """
    return F.when(text.rlike(f"[^{PLAIN}]"), _words(F.translate(text, FOREIGN, NATIVE), BETWEEN)).otherwise(_words(text, PLAIN_BETWEEN))


def template_string(words: Column) -> Column:
    """The same words, with typed placeholders for numbers, units and names."""
    number = F.regexp_replace(words, f"(?<= )[0-9][0-9{POINT}]*(?= )", NUMBER)
    some = F.when(words.rlike("[0-9]"), F.regexp_replace(number, f"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?= )", UNIT)).otherwise(words)
    return F.regexp_replace(some, f"{MARK}[^ ]+", NAME)


def _array(words: Column) -> Column:
    return F.split(F.trim(words), " ")


def _window_hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(WINDOW)))


def _windows(words: str) -> Column:
    """The window at every word as a struct; the last few, cut off at the end, have nulls."""
    return F.arrays_zip(*(F.slice(words, i + 1, F.size(words)).alias(f"w{i}") for i in range(WINDOW)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, item_template, item_words, item_values)`` of every item of ``WITHIN`` words or more."""
    named = benchmark.where("text is not null").select("item_id", word_string(F.col("text")).alias("w"))
    items = named.select("item_id", _array(template_string(F.col("w"))).alias("item_template"), _array(F.col("w")).alias("item_words"), slot_values(F.col("w")).alias("item_values"))
    return items.where(F.size("item_template") >= WITHIN).distinct().withColumn("item_key", F.xxhash64("item_id", "item_words"))


def item_windows(items: DataFrame) -> DataFrame:
    """``(window, item_key, item_at, n)``: the hash of every window of every item, and the item's words."""
    places = F.sequence(F.lit(0), F.size("item_template") - WINDOW)
    return items.select("*", F.explode(places).alias("item_at")).select(_window_hash(F.col("item_template"), F.col("item_at")).alias("window"), "item_key", "item_at", F.size("item_template").alias("n"))


def slot_values(words: Column) -> Column:
    """For each word what it stands for in a placeholder: of neighbouring names, or numbers, all of them together.

    So 'New York' in the place of 'Paris' is one value, whichever of its words is met.
    """
    names = F.regexp_replace(words, f"({MARK}[^ ]+) (?={MARK})", "$1" + JOIN)
    numbers = F.regexp_replace(names, f"(?<= )([0-9][0-9{POINT}]*) (?=[0-9][0-9{POINT}]* )", "$1" + JOIN)
    return F.flatten(F.transform(_array(numbers), lambda x: F.array_repeat(x, F.size(F.split(x, JOIN)))))


def _cuts(text: Column, places: Column) -> Column:
    """For each place of ``places`` the template words, words and slot values of the text under the item.

    The words are bound to a lambda's variable, so they are found once for each text, not for each place.
    """
    both = lambda w: F.struct(_array(template_string(w)).alias("t"), _array(w).alias("w"), slot_values(w).alias("v"))
    cut = lambda c, p: F.slice(c, F.greatest(p["shift"], F.lit(0)) + 1, p["n"] + F.least(p["shift"], F.lit(0)))
    one = lambda x: F.transform(places, lambda p: F.struct(p["item_key"].alias("item_key"), p["shift"].alias("shift"), p["linked"].alias("linked"), *(cut(x[c], p).alias(c) for c in "twv")))
    return F.flatten(F.transform(F.transform(F.array(word_string(text)), both), one))


def least_share(n_words: Column) -> Column:
    """The share from which an item counts: all of a short one."""
    return F.when(n_words < LEAST_WORDS, 1.0).otherwise(LEAST_SHARE)


def reach(n_words: Column) -> Column:
    """How far the shifts of two alignments may lie apart that are joined: half the item's words."""
    return F.greatest(F.lit(WITHIN), F.floor(n_words / 2))


def found_once(aligned: DataFrame) -> DataFrame:
    """``(text_key, item_key, share, substituted)`` of alignments that hold an item, or a long run of it, by themselves."""
    exact = lambda p: F.replace(p["x"], F.lit(MARK), F.lit("")) == F.replace(p["y"], F.lit(MARK), F.lit(""))
    run = F.array_join(F.transform("pairs", lambda p: F.when(exact(p), "1").otherwise("0")), "")
    agrees = lambda at: F.coalesce(F.get("pairs", at)["a"] == F.get("pairs", at)["b"], F.lit(False))
    values = lambda pairs: F.array_distinct(F.transform(pairs, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    slots = values(F.filter("pairs", lambda p: p["slot"] & (p["a"] == p["b"])))
    beside = values(F.filter("pairs", lambda p, i: p["slot"] & (p["a"] == p["b"]) & (agrees(i - 1) | agrees(i + 1))))
    consistent = lambda c: F.size(F.array_distinct(F.transform(c, lambda s: s["y"]))) == F.size(c)
    share = F.size(F.filter("pairs", lambda p: p["a"] == p["b"])) / F.col("n_words")
    told = aligned.select("text_key", "item_key", share.alias("share"), "n_words", F.contains(run, F.lit("1" * LONG_RUN)).alias("long"), slots.alias("slots"), beside.alias("beside"))
    whole, long = (F.col("share") >= least_share(F.col("n_words"))) & consistent("slots"), F.col("long") & consistent("beside")
    return told.where(whole | long).select("text_key", "item_key", "share", F.exists(F.when(whole, F.col("slots")).otherwise(F.col("beside")), lambda s: s["x"] != s["y"]).alias("substituted"))


def found_joined(aligned: DataFrame) -> DataFrame:
    """The same for alignments joined with those of neighbouring shifts.

    A position of the item counts once, with what it met in the longest run of agreeing words; a
    placeholder that agrees all alone is no evidence and counts in none.
    """
    key = ["text_key", "item_key"]
    linked = aligned.where("linked").dropDuplicates([*key, "shift"])
    agreed = linked.select(*key, "shift", F.posexplode("pairs").alias("at", "p")).where("p.a = p.b")
    hits = agreed.select(*key, "shift", (F.col("at") - F.least("shift", F.lit(0))).alias("k"), "p.slot", "p.u", "p.v")
    islands = hits.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy(*key, "shift").orderBy("k")))
    runs = islands.withColumn("run", F.count("*").over(Window.partitionBy(*key, "shift", "island"))).where("run > 1 or not slot")
    anchors = linked.select(*key, "n_words", F.col("shift").alias("anchor"))
    off = F.abs(F.col("shift") - F.col("anchor"))
    near = runs.join(anchors, key).where(off <= reach(F.col("n_words"))).groupBy(*key, "n_words", "anchor", "k")
    best = near.agg(F.max_by(F.struct("slot", "u", "v"), F.struct("run", -off, "shift")).alias("hit"))
    slots = F.collect_set(F.when(F.col("hit.slot"), F.struct("hit.u", "hit.v")))
    joined = best.groupBy(*key, "n_words", "anchor").agg((F.count("*") / F.col("n_words")).alias("share"), slots.alias("slots"))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["v"]))) == F.size("slots")
    return joined.where((F.col("share") >= least_share(F.col("n_words"))) & consistent).select(*key, "share", F.exists("slots", lambda s: s["u"] != s["v"]).alias("substituted"))


def _plain(text: Column) -> Column:
    return F.replace(word_string(text), F.lit(MARK), F.lit(""))


def tiny_items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, n_words)`` of the items of fewer than ``WITHIN`` words, at least one."""
    named = benchmark.where("text is not null").select("item_id", _plain(F.col("text")).alias("words")).withColumn("n_words", F.size(_array(F.col("words"))))
    return named.where((F.col("n_words") < WITHIN) & (F.trim("words") != "")).distinct()


def tiny_leaks(texts: DataFrame, tiny: DataFrame) -> DataFrame:
    """The rows of :func:`text_leaks` for ``tiny`` items: each is a whole line or a whole text."""
    lines = texts.select("text_key", F.explode(F.array_append(F.split("text", r"[\r\n]+"), F.col("text"))).alias("line"))
    met = lines.select("text_key", _plain(F.col("line")).alias("words")).join(tiny, "words")
    return met.select("text_key", "item_id", F.lit(1.0).alias("share"), "n_words", F.lit(False).alias("substituted"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``text`` and its hash of every row with a text, and ``doc_id``."""
    return docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def alignments(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """``(text_key, places)``: where items may lie in texts, at most about ``PLACES`` in a row; checkpointed.

    A place has ``item_key``, ``shift``, ``n`` and whether another alignment of the item lies near (``linked``).
    """
    template = texts.select("text_key", _array(template_string(word_string(F.col("text")))).alias("t"))
    # The outer form keeps Catalyst from adding a filter that would run the expressions twice; rows carry no texts.
    pieces = template.select("text_key", F.posexplode_outer(_windows("t")).alias("at", "w"))
    pieces = pieces.select("text_key", "at", F.xxhash64(*(f"w.w{i}" for i in range(WINDOW))).alias("window"))
    met = pieces.join(windows, "window").select("text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift"), "n").distinct()
    order = Window.partitionBy("text_key", "item_key").orderBy("shift")
    apart = F.least(F.col("shift") - F.lag("shift").over(order), F.lead("shift").over(order) - F.col("shift"))
    linked = checkpointed(met.withColumn("linked", F.coalesce(apart <= reach(F.col("n")), F.lit(False))))
    many = linked.groupBy("text_key").agg(F.ceil(F.count("*") / PLACES).alias("rows"))
    part = F.pmod(F.xxhash64("item_key", "shift"), F.col("rows"))
    return checkpointed(linked.join(many, "text_key").groupBy("text_key", part.alias("part")).agg(F.collect_list(F.struct("item_key", "shift", "n", "linked")).alias("places")))


def aligned_pairs(texts: DataFrame, places: DataFrame, items: DataFrame) -> DataFrame:
    """``(text_key, item_key, item_id, shift, linked, n_words, pairs)``: the words that meet along each alignment."""
    cut = texts.join(places, "text_key").select("text_key", _cuts(F.col("text"), F.col("places")).alias("cuts"))
    placed = cut.select("text_key", F.explode_outer("cuts").alias("c")).select("text_key", "c.*").dropDuplicates(["text_key", "item_key", "shift"]).join(items, "item_key")
    own = lambda c: F.slice(F.col(c), 1 - F.least("shift", F.lit(0)), F.size("item_template"))
    zipped = F.arrays_zip(F.col("t").alias("a"), own("item_template").alias("b"), F.col("w").alias("x"), own("item_words").alias("y"), F.col("v").alias("u"), own("item_values").alias("v"))
    fields = lambda p: [p[c].alias(c) for c in ("a", "b", "x", "y", "u", "v")]
    pairs = F.transform(zipped, lambda p: F.struct(*fields(p), p["b"].isin(NUMBER, UNIT, NAME).alias("slot")))
    return placed.select("text_key", "item_key", "item_id", "shift", "linked", F.size("item_template").alias("n_words"), pairs.alias("pairs"))


def text_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of :func:`leaks` by ``text_key``, the hash of the text, in place of ``doc_id``; checkpointed."""
    items = checkpointed(benchmark_items(benchmark))
    windows = checkpointed(item_windows(items))
    near = F.broadcast if windows.count() <= BROADCAST_WINDOWS else (lambda x: x)
    texts = _keyed(docs)
    places = alignments(texts, near(windows))
    few = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0] <= BROADCAST_WINDOWS
    aligned = checkpointed(aligned_pairs(texts, F.broadcast(places) if few else places, near(items)))
    key = ["text_key", "item_key"]
    found = found_once(aligned).union(found_joined(aligned)).groupBy(*key).agg(F.max("share").alias("share"), F.min("substituted").alias("substituted"))
    long = aligned.select(*key, "item_id", "n_words").distinct().join(found, key).select("text_key", "item_id", "share", "n_words", "substituted")
    tiny = checkpointed(tiny_items(benchmark))
    if number := tiny.count():
        long = long.unionByName(tiny_leaks(texts, F.broadcast(tiny) if number <= BROADCAST_WINDOWS else tiny))
    merged = long.groupBy("text_key", "item_id").agg(F.max("share").alias("share"), F.max("n_words").alias("n_words"), F.min("substituted").alias("substituted"))
    return checkpointed(merged)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, share, n_words, substituted)``: the benchmark items that documents hold.

    ``share`` is the largest part of the item's words that agree in place (at least 0.6) along one alignment,
    or along alignments of neighbouring shifts together, which inserted and lost words split; or an item is
    held by ``LONG_RUN`` of its words in a row, word for word, whatever the share, unless the values of the
    placeholders beside other agreeing words contradict each other. ``n_words`` is the words of the item,
    ``substituted`` whether a placeholder has another value than in the item. Items of 5 to 11 words must agree
    in all their words; items of fewer than 5 are held where they are a whole line or a whole text, their words
    being equal. An item of which no ``WINDOW`` words in a row agree is not found. Null and empty texts and items
    hold nothing; equal rows give one row; rows without ``doc_id`` appear with a null id. Empty tables give no rows.
    """
    found = broadcast_if_small(text_leaks(docs, benchmark))
    met = _keyed(docs).select("doc_id", "text_key").join(found, "text_key")
    return met.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("n_words").alias("n_words"), F.min("substituted").alias("substituted"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, with or without ``doc_id``.

    Up to a count of texts that go their hashes are broadcast, and no text is shuffled.
    """
    held = broadcast_if_small(text_leaks(docs, benchmark).select(F.col("text_key").alias("_gridfold_held")).distinct())
    return docs.join(held, F.xxhash64("text") == F.col("_gridfold_held"), "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` that all ``documents`` hold, by :func:`leaks`."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Licence scan by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-case words with single spaces. Only texts that hold a stem of some keyword are
normalised, and only rules whose keyword occurs are matched, each by its own literal pattern. A match covers
an interval of words; sorted by start and falling end, an interval is suppressed where one that contains it
has the same or a better priority, and of equal ones the earlier rule's stays. All of it happens within
the row: the scan needs no shuffle, and its work grows with the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import count_words, lower_ascii, table
from gridfold.llm.license_rules import WRITTEN

#: Phrases and their base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Characters for private use that mark the ends of a match; no word holds them after normalisation.
BEGIN, END = "\x01", "\x02"
PRIORITIES = 4
#: Stems of keywords whose longest word is a common one.
STEM = {"creative commons": "commons", "public domain": "domain", "is hereby granted": "hereby", "permission is hereby granted": "hereby", "without royalty": "royalty"}
#: The version at the end of a match, before what may stand behind it.
VERSION = r"v?([0-9](?: [0-9]{1,2})?)(?: (?:or|only|later|international|unported|generic|licen[cs]es?))*$"


def stems() -> list[str]:
    """Strings of which at least one occurs in any lower-cased text that has a detection.

    Of a keyword whose rules all hold the word licence that word's stem counts, else its longest word.
    """
    certain: dict[str, bool] = {}
    for _, keyword, body, *_ in WRITTEN:
        needed = body
        while (less := re.sub(r"\(\?:[^()]*\)\??", "", needed)) != needed:  # what stands in no group
            needed = less
        certain[keyword] = certain.get(keyword, True) and ("licen" in keyword or ("licen" in needed and "|" not in needed))
    words = {"licen" if sure else STEM.get(keyword) or max(keyword.split(), key=len) for keyword, sure in certain.items()}
    words = (words | {"licen", "reserved"}) - {"cc"}  # of the base phrases; "cc by" is looked for by itself
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def may_match(lowered: Column) -> Column:
    """Whether a lower-cased text holds a stem; ``cc`` counts only where ``by`` is the next word."""
    held = lowered.rlike(r"cc[^a-z0-9\u0080-￿]+by")
    for word in stems():
        held = held | F.contains(lowered, F.lit(word))
    return held


def normalised(text: Column) -> Column:
    """Lower-case words with one space on either side of each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _marked(words: Column) -> Column:
    """``(rule, text)`` of every rule that matches: its number, and the words with its matches between marks."""
    by_keyword: dict[str, list[int]] = {}
    for i, (_, keyword, *_) in enumerate(WRITTEN):
        by_keyword.setdefault(keyword, []).append(i)
    one = lambda i: F.struct(F.lit(i).alias("rule"), F.regexp_replace(words, f" (?:{WRITTEN[i][2]})(?= )", f"{BEGIN}$0{END}").alias("text"))
    gated = [F.when(F.contains(words, F.lit(f" {keyword}")), F.array(*map(one, own))) for keyword, own in by_keyword.items()]
    tried = F.flatten(F.filter(F.array(*gated), lambda x: x.isNotNull()))
    return F.filter(tried, lambda x: F.contains(x["text"], F.lit(BEGIN)))


def _spans(text: Column) -> Column:
    """``(start, end, hit)`` of the marked matches of a rule, in words from 0, end included."""
    spans = "array<struct<start:int,end:int,hit:string>>"

    def step(a: Column, piece: Column) -> Column:
        hit = F.substring_index(piece, END, 1)
        n = _spaces(hit)
        found = F.struct(a["at"].alias("start"), (a["at"] + n - 1).alias("end"), hit.alias("hit"))
        return F.struct((a["at"] + _spaces(piece)).alias("at"), F.array_append(a["spans"], found).alias("spans"))

    pieces = F.split(text, BEGIN)
    start = F.struct(_spaces(F.element_at(pieces, 1)).alias("at"), F.array().cast(spans).alias("spans"))
    return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda a: a["spans"])


def _detections(marked: Column) -> Column:
    """All matches with the label, priority and weight of their rule."""
    known = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(weight).alias("weight")) for label, _, _, priority, weight in WRITTEN))

    def found(m: Column) -> Column:
        rule = known[m["rule"]]
        return F.transform(_spans(m["text"]), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), rule["priority"].alias("priority"), m["rule"].alias("rule"),
            labelled(rule["label"], s["hit"]).alias("label"), rule["weight"].alias("weight"),
        ))

    return F.flatten(F.transform(marked, found))


def labelled(label: Column, hit: Column) -> Column:
    """The label of a match: one that ends in a dash takes the version in the match, as in ``gpl-2.0``."""
    version = F.regexp_extract(hit, VERSION, 1)
    dotted = F.when(F.contains(version, F.lit(" ")), F.replace(version, F.lit(" "), F.lit("."))).otherwise(F.concat(version, F.lit(".0")))
    return F.when(F.endswith(label, F.lit("-")), F.concat(label, dotted)).otherwise(label)


def _surviving(found: Column) -> Column:
    """Detections not contained in one of the same or a better priority; of equal ones that of the first rule."""
    kept = "array<struct<start:int,back:int,priority:int,rule:int,label:string,weight:double>>"
    start = F.struct(*(F.lit(-1).alias(f"m{p}") for p in range(1, PRIORITIES + 1)), F.array().cast(kept).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        reach = a[f"m{PRIORITIES}"]
        for p in range(PRIORITIES - 1, 0, -1):
            reach = F.when(x["priority"] == p, a[f"m{p}"]).otherwise(reach)
        ends = [F.when(x["priority"] <= p, F.greatest(a[f"m{p}"], -x["back"])).otherwise(a[f"m{p}"]).alias(f"m{p}") for p in range(1, PRIORITIES + 1)]
        return F.struct(*ends, F.when(reach >= -x["back"], a["kept"]).otherwise(F.array_append(a["kept"], x)).alias("kept"))

    return F.aggregate(F.array_sort(found), start, step, lambda a: a["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``words`` (null where no keyword stem occurs) and ``detections``.

    ``detections`` is an array of ``(start, end, label, priority, weight)`` of the surviving matches, in word
    positions from 0. Null and empty texts have no words and no detections; repeated rows are scanned
    one by one. Other columns of ``docs`` stay as they are; columns of these three names are replaced.
    """
    columns = [x for x in docs.columns if x not in ("n_words", "words", "detections")]
    n_words = count_words(F.col("text"), r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")
    counted = docs.select(*columns, n_words.alias("n_words"), F.lower("text").alias("_gridfold_lower"))
    named = counted.select(*columns, "n_words", F.when(may_match(F.col("_gridfold_lower")), normalised(F.col("text"))).alias("words"))
    # Lambdas bind the words and the matches once for each text.
    marked = F.transform(F.filter(F.array("words"), lambda w: w.isNotNull()), _marked)
    met = F.filter(marked, lambda m: F.size(m) > 0)
    kept = F.flatten(F.transform(met, lambda m: _surviving(_detections(m))))
    told = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), x["priority"].alias("priority"), x["weight"].alias("weight")))
    return named.select(*columns, "n_words", "words", told.alias("_gridfold_found")).select(*columns, "n_words", "words", F.when(F.size("_gridfold_found") > 0, F.col("_gridfold_found")).alias("detections"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and all labels of every document, from the words and detections of :func:`scan`."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.col("words")
    counts = {p: F.coalesce(F.regexp_count(words, F.lit(f" {p}(?= )")), F.lit(0)).cast("long") for p in BASE}
    first = {p: F.when(words.contains(f" {p} "), _spaces(F.substring_index(words, f" {p} ", 1))) for p in BASE}
    last = {p: F.when(words.contains(f" {p} "), F.col("n_words") - _spaces(F.substring_index(words, f" {p} ", -1)) - len(p.split())) for p in BASE}
    base = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(words.contains(f" {p} "), F.lit(label)) for p, label in BASE.items())), lambda x: x.isNotNull())))
    own = F.coalesce(F.transform("detections", lambda x: x["label"]), F.array().cast("array<string>"))
    weight = F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", sum(counts.values()).alias("n_base"), F.least(*first.values()).cast("long").alias("first_word"), F.greatest(*last.values()).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), F.greatest(weight, F.when(F.size(base) > 0, 0.6).otherwise(0.0)).alias("score"), F.coalesce(F.size("detections"), F.lit(0)).alias("n_detections"),
    )

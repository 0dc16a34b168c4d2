"""Benchmark decontamination with a distributed positional inverted index, on DataFrames alone.

Counts of the test terms over all training texts tell the rarest and the second rarest term of each
test window. The index keeps, for these terms, a posting list for each document that has them: the
sorted places. A window's rarest term finds its documents; its list, moved by the term's offset in
the window, is intersected with the second's list, moved by that one's. What both leave are places
where the window may begin: there the words themselves are compared, in one pass over the texts that
also counts their words. A window with a term that no training text has is ruled out at once.

Proximity is asked of the same lists: a window is near where all its words, in any order, stand in
its length and `SLACK` words more. Such a span has both terms, so only places of the rarest with one
of the second within that length are compared.

Test terms and windows meet the texts and lists by broadcasts of bounded parts; the texts are read
again for each part of the terms, and no term, however frequent, gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.llm.exchange import NO_ID, written

#: Rows of test terms and of test windows that are broadcast at a time; more are joined part by part.
BROADCAST_TERMS, BROADCAST_WINDOWS = 200_000, 50_000
#: Words that may stand between the words of a window that is near.
SLACK = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text before its A-Z become a-z.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _raw(text: Column) -> Column:
    """Words as they stand; the first and the last may be empty."""
    return F.split(F.coalesce(text, F.lit("")), _BETWEEN)


def _lowered(words: Column) -> Column:
    return F.transform(words, lambda x: F.translate(x, _UPPER, _LOWER))


def _code(word: Column) -> Column:
    # lower() joins at least what A-Z to a-z joins, and is quick on ASCII; words are compared later
    return F.xxhash64(F.lower(word))


def _blank_first(words: str) -> Column:
    return F.when(F.col(words)[0] == "", 1).otherwise(0)


def _n_words(words: str) -> Column:
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - _blank_first(words) - last).cast("bigint")


def _parts(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The frame in broadcast parts of about `most` rows or fewer, dealt by a key."""
    k = max(1, -(-df.count() // most))
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(k)) == i)) for i in range(k)]


def _union(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """Distinct test windows: words (array), code, items (sorted array of item ids as strings)."""
    words = F.filter(_lowered(_raw(F.col("text").cast("string"))), lambda x: x != "")
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - width + 1))
    each = own.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), width).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("code", F.xxhash64("words"))


def term_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(term, n): occurrences in all texts of each code of a window's word; terms without any are left out."""
    terms = windows.select(F.explode("words").alias("word")).select(_code(F.col("word")).alias("term")).distinct()
    found = docs.select(F.explode(_raw(F.col("text"))).alias("word")).filter("word <> ''").select(_code(F.col("word")).alias("term"))
    return _union([found.join(part, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")) for part in _parts(terms, "term", BROADCAST_TERMS)])


def rarest_of(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(code, words, n_words, offset, term, second_offset, second): each window with its rarest term and
    the rarest of the others, or the same where there is none, and the offset that each has there.
    Windows with a term that no text has are left out."""
    at = windows.select("code", "words", F.posexplode("words").alias("offset", "word")).withColumn("term", _code(F.col("word")))
    counted = _union([at.join(part, "term") for part in _parts(counts, "term", BROADCAST_TERMS)])
    ranked = counted.groupBy("code", "words").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms")).filter(F.size("terms") == F.size("words"))
    ranked = ranked.select("code", "words", F.col("terms")[0].alias("r"), "terms")
    other = F.coalesce(F.get(F.filter("terms", lambda x: x["term"] != F.col("r.term")), F.lit(0)), F.col("r"))
    return ranked.select("code", "words", F.size("words").alias("n_words"), "r.offset", "r.term", other["offset"].alias("second_offset"), other["term"].alias("second"))


def index_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index of texts (id, mark, text) for terms (term): id, mark, term, places (from 0, sorted)."""
    split = docs.select("id", "mark", _raw(F.col("text")).alias("words"))
    each = split.select("id", "mark", _blank_first("words").alias("first"), F.posexplode("words").alias("at", "word")).filter("word <> ''")
    each = each.select("id", "mark", _code(F.col("word")).alias("term"), (F.col("at") - F.col("first")).alias("place"))
    met = _union([each.join(part, "term") for part in _parts(terms, "term", BROADCAST_TERMS)])
    return met.groupBy("id", "mark", "term").agg(F.array_sort(F.collect_set("place")).alias("places"))


def intersections(index: DataFrame, rarest: DataFrame, near: bool = True, slack: int = SLACK) -> DataFrame:
    """(id, mark, code, words, starts, close): where windows may begin in documents, by the lists of
    their two terms, and (with `near`) places of the rarest term with the second close to it."""
    first = _union([index.join(part, "term").drop("term") for part in _parts(rarest, "code", BROADCAST_WINDOWS)])
    second = index.select("id", "mark", F.col("term").alias("second"), F.col("places").alias("others"))
    both = first.join(second, ["id", "mark", "second"])
    moved = lambda places, offset: F.transform(places, lambda p: p - F.col(offset))
    starts = F.filter(F.array_intersect(moved("places", "offset"), moved("others", "second_offset")), lambda s: s >= 0)
    most = F.col("n_words") - 1 + slack
    close = F.filter("places", lambda p: F.exists("others", lambda q: F.abs(p - q) <= most)) if near else F.array().cast("array<int>")
    found = both.select("id", "mark", "code", "words", starts.alias("starts"), close.alias("close"))
    return found.filter((F.size("starts") > 0) | (F.size("close") > 0))


def _holds(span: Column, words: Column) -> Column:
    """Whether a span has each of the words at least as often as they have it."""
    times = lambda among, w: F.size(F.filter(among, lambda x: x == w))
    return F.forall(words, lambda w: times(span, w) >= times(words, w))


def _is_near(words: str, first: str, slack: int):
    """Whether a candidate's words all stand in a span around one of its close places."""

    def run(c: Column) -> Column:
        most = F.size(c["words"]) + slack

        def at(place: Column) -> Column:
            low = F.greatest(F.lit(0), place - most + 1)
            # The words around a place once, for all spans that hold it.
            around = F.array(_lowered(F.slice(words, low + F.col(first) + 1, place - low + most)))
            return F.exists(around, lambda x: F.exists(F.sequence(F.lit(1), place - low + 1), lambda s: _holds(F.slice(x, s, most), c["words"])))

        return F.exists(c["close"], at)

    return run


def matched(docs: DataFrame, candidates: DataFrame, slack: int = SLACK) -> DataFrame:
    """(id, mark, n_words, n_hit, codes, near_codes) of each text: its words, those inside exact
    occurrences of windows, and the windows that occur and that are near."""
    listed = candidates.groupBy("id", "mark").agg(F.collect_list(F.struct("code", "words", "starts", "close")).alias("asked"))
    texts = docs.select("id", "mark", "text").join(listed.hint("merge"), ["id", "mark"], "left")
    texts = texts.withColumn("asked", F.coalesce("asked", F.array().cast(listed.schema["asked"].dataType)))
    split = texts.select("id", "mark", _raw(F.col("text")).alias("words"), "asked").withColumn("first", _blank_first("words"))
    stands = lambda c: F.filter(c["starts"], lambda s: _lowered(F.slice("words", s + F.col("first") + 1, F.size(c["words"]))) == c["words"])
    exact = F.filter(F.transform("asked", lambda c: F.struct(c["code"].alias("code"), F.size(c["words"]).alias("n"), stands(c).alias("starts"))), lambda c: F.size(c["starts"]) > 0)
    found = split.select("id", "mark", _n_words("words").alias("n_words"), exact.alias("exact"), F.transform(F.filter("asked", _is_near("words", "first", slack)), lambda c: c["code"]).alias("near_codes"))
    spans = F.array_sort(F.flatten(F.transform("exact", lambda c: F.transform(c["starts"], lambda s: F.struct(s.alias("start"), (s + c["n"]).alias("end"))))))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"))
    n_hit = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]
    return found.select("id", "mark", "n_words", F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"), F.transform("exact", lambda c: c["code"]).alias("codes"), "near_codes")


def _named(found: DataFrame, windows: DataFrame, codes: str, name: str) -> DataFrame:
    """(id, mark, `name`): the items of the windows in a column of codes, sorted."""
    each = found.select("id", "mark", F.explode(codes).alias("code")).distinct()
    met = _union([each.join(part, "code") for part in _parts(windows.select("code", "items"), "code", BROADCAST_WINDOWS)])
    return met.select("id", "mark", F.explode("items").alias("item")).groupBy("id", "mark").agg(F.array_sort(F.collect_set("item")).alias(name))


def _or_none(items: str) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, near: bool = True) -> DataFrame:
    """Benchmark passages in documents (doc_id, text); benchmark items are (item_id, text).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z become a-z. A window is `width` words in a
    row of an item, or a shorter item whole. One row for each row of docs: doc_id, n_words, n_hit
    (words inside any occurrence of a window), n_items (items with occurring windows), items (their
    ids as sorted strings), items_sha256 (of items, comma-joined), contaminated (n_hit > 0), and
    n_near_items and near_items (the same of items with windows that are near: all words, in any
    order, in the window's length and SLACK words more; windows that occur are near too). Without
    `near` these two are left out.

    Null texts have no words; items without words have no windows; a null item_id stands as the
    empty string. A null doc_id stays null. Repeated rows get equal rows. A text of any length is one
    row. Empty tables give an empty table, or one without hits. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    windows = written(windows_of(items, width))
    rarest = written(rarest_of(windows, written(term_counts(docs, windows))))
    terms = rarest.select(F.explode(F.array("term", "second")).alias("term")).distinct()
    index = written(index_of(keyed, terms))
    found = written(matched(keyed, intersections(index, rarest, near)))
    joined = found.join(_named(found, windows, "codes", "items"), ["id", "mark"], "left")
    own, more = _or_none("items"), []
    if near:
        joined = joined.join(_named(found, windows, "near_codes", "near_items"), ["id", "mark"], "left")
        more = [F.size(_or_none("near_items")).cast("bigint").alias("n_near_items"), _or_none("near_items").alias("near_items")]
    return joined.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size(own).cast("bigint").alias("n_items"),
        own.alias("items"),
        F.sha2(F.array_join(own, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        *more,
    )

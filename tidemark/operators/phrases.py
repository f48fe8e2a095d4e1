"""Phrases of a lexicon table in texts: one automaton finds all of them with their places in one pass.

A lexicon is a table (phrase, kind) in lower case, with a weight where it has one; nothing here knows a word. Texts are lowered, and
places count code points and words of the lowered text. Words are what stands between white space and , ; . ! ?
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEPARATORS = " \t\n\x0b\f\r,;.!?"
WORD = re.compile(rf"[^{SEPARATORS}]+")
#: Stands between words when whole words are searched for: a separator, so no word holds it.
BOUND = " "
#: A phrase with a separator.
LONG = r"[ \t\n\x0b\f\r,;.!?]"
#: Distinct words whose occurrences a worker keeps.
KEPT_WORDS = 1 << 17
#: Bytes of a lexicon that are sent to every executor. One-word phrases of a larger one are joined instead.
MOST_BYTES = 64 << 20
#: Hits that a task hands over at a time.
HITS = 50_000
#: How many words before a word a negation may stand.
WINDOW = 3


def _size(lexicon: DataFrame) -> int:
    return lexicon.agg(F.sum(F.octet_length("phrase") + F.octet_length("kind") + 16).alias("n")).first().n or 0


def _meanings(lexicon: DataFrame, most_bytes: int) -> list[tuple[str, str, float]]:
    """The rows of a lexicon whose size is known to be bounded."""
    if _size(lexicon) > most_bytes:
        raise ValueError(f"the lexicon is larger than {most_bytes} bytes")
    weight = F.col("weight").cast("double") if "weight" in lexicon.columns else F.lit(1.0)
    return [tuple(r) for r in lexicon.where("phrase <> '' and kind is not null").select("phrase", "kind", weight).distinct().collect()]


def _machine(rows, spell):
    """An automaton whose values are phrases with their meanings, found as they are spelled; None without a phrase."""
    machine, meanings = ahocorasick.Automaton(), {}
    for phrase, kind, weight in rows:
        meanings.setdefault(phrase, []).append((phrase, kind, weight))
    for phrase, meant in meanings.items():
        spelled = spell(phrase)
        machine.add_word(spelled, (len(spelled), machine.get(spelled, (0, []))[1] + meant))
    if len(machine) == 0:
        return None
    machine.make_automaton()
    return machine


def _bounded(words: list[str]) -> str:
    return BOUND + BOUND.join(words) + BOUND


def _search(texts: DataFrame, lexicon: DataFrame, keys: tuple[str, ...], text: str, most_bytes: int, spell, found: str, occurrences) -> DataFrame:
    """A row for each of the tuples that occurrences(machine, lowered text) gives, with the keys of its text."""
    shared = texts.sparkSession.sparkContext.broadcast(_meanings(lexicon, most_bytes))
    rows = texts.where(F.col(text).isNotNull()).select(*keys, F.lower(text).alias("_text"))
    schema = T.StructType(rows.schema.fields[:-1] + T._parse_datatype_string(found).fields)
    names = schema.fieldNames()

    def run(frames):
        machine, out = _machine(shared.value, spell), []
        for frame in frames:
            for *key, lowered in frame.itertuples(index=False, name=None) if machine else ():
                for hit in occurrences(machine, lowered):
                    out.append((*key, *hit))
                    if len(out) == HITS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def _anywhere(machine, lowered: str):
    starts, ends = [m.start() for m in WORD.finditer(lowered)], {}
    for last, (length, meant) in machine.iter(lowered):
        at, phrase = last + 1 - length, meant[0][0]
        apart = at >= ends.get(phrase, 0)
        if apart:
            ends[phrase] = last + 1
        for m in meant:
            yield *m, at, bisect_right(starts, at) - 1, apart


def _whole(machine, lowered: str):
    words = WORD.findall(lowered)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    for last, (length, meant) in machine.iter(_bounded(words)):
        word = bisect_right(starts, last + 1 - length) - 1
        for m in meant:
            yield *m, word


def find(texts: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, phrase, kind, weight, at, word, apart): every occurrence of every phrase as it is spelled, also inside words and across one
    another. at: its first code point; word: the word that it begins in, or the one before; apart: it does not overlap the one
    before of its own phrase that is apart. Null texts and phrases have none. A lexicon above most_bytes is refused."""
    return _search(texts, lexicon, keys, text, most_bytes, str, "phrase string, kind string, weight double, at int, word int, apart boolean", _anywhere)


def whole(texts: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(keys, phrase, kind, weight, word): where the words of a phrase stand one after another, whatever is between words; word: the place
    of the first. A phrase without a word has none. A lexicon above most_bytes is refused."""
    worded = lexicon.where(F.col("phrase").rlike(r"[^\s,;.!?]"))
    return _search(texts, worded, keys, text, most_bytes, lambda p: _bounded(WORD.findall(p)), "phrase string, kind string, weight double, word int", _whole)


def words(documents: DataFrame, *besides: str) -> DataFrame:
    """(doc_id, pos, word) and the columns named besides: the words of each text in lower case."""
    every = F.filter(F.split(F.lower("text"), r"[\s,;.!?]+"), lambda w: w != "")
    return documents.select("doc_id", *besides, F.posexplode(every).alias("pos", "word"))


def _word_counts(documents: DataFrame) -> DataFrame:
    """(lang, word, n, docs) of texts whose doc_id no other row has: a text tells by itself in which of its words it counts, so words
    are summed up where the texts are read."""
    every = documents.where("lang is not null").select("lang", F.filter(F.split(F.lower("text"), r"[\s,;.!?]+"), lambda w: F.length(w) >= 4).alias("_words"))
    row = lambda n, docs: lambda w: F.struct(w.alias("word"), F.lit(n).alias("n"), F.lit(docs).alias("docs"))
    counted = F.concat(F.transform("_words", row(1, 0)), F.transform(F.array_distinct("_words"), row(0, 1)))
    return every.select("lang", F.inline(counted)).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def topics(documents: DataFrame, most: int = 10) -> DataFrame:
    """N11 (lang, place, word, n): the most frequent words of four letters or more of each language, without those of over half of its
    documents. Rows that share a doc_id are one document, in each language they name."""
    rows = documents.where("doc_id is not null").select("doc_id", "lang", "text")
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id")
    if shared.isEmpty():
        counts = _word_counts(rows)
    else:
        several = rows.join(shared.hint("merge"), "doc_id", "left_semi")
        met = words(several).where(F.length("word") >= 4).hint("merge").join(several.select("doc_id", "lang"), "doc_id").where("lang is not null")
        counts = _word_counts(rows.join(shared.hint("merge"), "doc_id", "left_anti")).unionByName(met.groupBy("lang", "word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")))
        counts = counts.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sizes = documents.groupBy("lang").agg(F.count("*").alias("_all"))  # a row for each language
    kept = counts.join(F.broadcast(sizes), "lang").where(F.col("docs") * 2 <= F.col("_all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("lang", "place", "word", "n")


def hits(documents: DataFrame, lexicon: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, pos, phrase, kind): whole words and phrases with the place of their first word. One-word phrases are joined with the words
    where the texts are read, or beyond most_bytes by a merge join; only longer ones need the automaton."""
    lexicon = lexicon.where("phrase <> '' and kind is not null").select("phrase", "kind").distinct()
    long = F.col("phrase").rlike(LONG)
    sizes = lexicon.agg(F.sum(F.octet_length("phrase") + F.octet_length("kind") + 16).alias("bytes"), F.count_if(long).alias("long")).first()
    one = lexicon.where(~long).hint("broadcast" if (sizes.bytes or 0) <= most_bytes else "merge")
    joined = words(documents).withColumnRenamed("word", "phrase").join(one, "phrase").select("doc_id", "pos", "phrase", "kind")
    if not sizes.long:
        return joined
    return joined.unionByName(whole(documents, lexicon.where(long)).select("doc_id", F.col("word").alias("pos"), "phrase", "kind"))


def _signed(found: DataFrame, keys: list[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("word").rangeBetween(-WINDOW, -1)
    negations = F.count(F.when(F.col("kind") == "negation", 1)).over(before)
    sign = F.when(F.col("kind") == "positive", 1).otherwise(-1) * F.when(negations > 0, -1).otherwise(1)
    return found.where(F.col("kind").isin("positive", "negative", "negation")).withColumn("_sign", sign).where("kind <> 'negation'")


def articles(news: DataFrame, lexicon: DataFrame) -> DataFrame:
    """N1, N2 (id, score) of news (id, title, description, keywords): twice the title's score, the description's, and half of each
    keyword's. A word counts 1 or -1 by its kind, turned round when a negation stands within three words before it in the same field.
    Articles without a word of the lexicon score 0; null fields count nothing."""
    title = F.struct(F.lit(2.0).alias("factor"), F.col("title").alias("text"))
    description = F.struct(F.lit(1.0).alias("factor"), F.col("description").alias("text"))
    keywords = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.struct(F.lit(0.5).alias("factor"), k.alias("text")))
    fields = news.select("id", F.posexplode(F.concat(F.array(title, description), keywords)).alias("field", "x")).select("id", "field", "x.factor", "x.text")
    found = whole(fields, lexicon, ("id", "field", "factor"))
    scores = _signed(found, ["id", "field"]).groupBy("id").agg(F.sum(F.col("_sign") * F.col("factor")).alias("score"))
    return news.select("id").join(scores.hint("merge"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def _in_words(texts: DataFrame, meanings: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, positive, negative): occurrences of phrases without separators. They lie within words, so a word's are counted once
    while a worker keeps it."""
    shared = texts.sparkSession.sparkContext.broadcast(meanings)
    rows = texts.where("text is not null").select("doc_id", F.lower("text").alias("_text"))
    schema = T.StructType(rows.schema.fields[:-1] + T._parse_datatype_string("positive bigint, negative bigint").fields)

    def run(frames):
        machine = _machine(shared.value, str)

        @lru_cache(KEPT_WORDS)
        def counts(word: str) -> tuple[int, int]:
            kinds = [kind for _, kind, _, _, _, apart in _anywhere(machine, word) if apart]
            return kinds.count("positive"), kinds.count("negative")

        for frame in frames:
            found = [[counts(w) for w in WORD.findall(t)] if machine else [] for t in frame["_text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "positive": [sum(p for p, _ in f) for f in found], "negative": [sum(n for _, n in f) for f in found]})

    return rows.mapInPandas(run, schema)


def keyword_counts(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """N9 (doc_id, positive, negative, sentiment): occurrences of keywords, inside words too, and (p - n) / (p + n); 0 where there is
    none. The same phrase does not count across itself."""
    meanings, kinds = _meanings(keywords, MOST_BYTES), ("positive", "negative")
    found = _in_words(texts.select("doc_id", "text"), [m for m in meanings if not re.search(LONG, m[0])])
    if any(re.search(LONG, m[0]) for m in meanings):
        long = find(texts, keywords.where(F.col("phrase").rlike(LONG))).where("apart")
        found = found.unionByName(long.select("doc_id", *[(F.col("kind") == k).cast("bigint").alias(k) for k in kinds]))
    found = found.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in kinds])
    n = F.col("positive") + F.col("negative")
    every = texts.select("doc_id").join(found.hint("merge"), "doc_id", "left").na.fill(0, ["positive", "negative"])
    return every.withColumn("sentiment", F.coalesce(F.try_divide(F.col("positive") - F.col("negative"), n), F.lit(0.0)))


def phrase_counts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """N11, N12 (doc_id, kind, phrase, n): how often each phrase of a kind occurs in a text, every time counted."""
    return find(texts, phrases).where("apart").groupBy("doc_id", "kind", "phrase").agg(F.count("*").alias("n"))

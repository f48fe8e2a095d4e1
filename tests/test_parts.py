"""What a task holds does not grow with the input: parts of bars by size, and words joined where texts are read."""

import datetime as dt

from tidemark.operators import phrases
from tidemark.sources import views


def test_parts_of_bars_grow_with_the_line_items(spark):
    rows = [(o, 1, o % 20, 1, 2.0, 10.0 + o % 9, dt.datetime(2020, 1, 1) + dt.timedelta(days=o % 60)) for o in range(900)]
    items = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    few, many = views.bars(items), views.bars(items, part_rows=30)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 30
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 60
    assert views.bars(items.where("false")).count() == 0


def test_words_need_no_worker(spark):
    docs = spark.createDataFrame([(1, "Good good, bad!"), (2, None), (3, ""), (4, "not\tgood")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("good", "positive"), ("good", "positive"), ("bad", "negative"), ("not", "negation"), ("", "negation"), (None, "negation")], "phrase string, kind string")
    want = [(1, 0, "good", "positive"), (1, 1, "good", "positive"), (1, 2, "bad", "negative"), (4, 0, "not", "negation"), (4, 1, "good", "positive")]
    for most in (phrases.MOST_BYTES, 0):
        found = phrases.hits(docs, lexicon, most)
        assert sorted(map(tuple, found.collect())) == want
        assert "MapInPandas" not in found._jdf.queryExecution().toString()
    longer = lexicon.unionByName(spark.createDataFrame([("good bad", "negative")], lexicon.schema))
    assert sorted(map(tuple, phrases.hits(docs, longer).collect())) == sorted([*want, (1, 1, "good bad", "negative")])


def test_occurrences_leave_a_text_as_one_row(spark):
    docs = spark.createDataFrame([(1, "aaaa aa, xaab"), (2, None), (3, "a a")], "doc_id bigint, text string")
    words = spark.createDataFrame([("aa", "positive"), ("b", "negative")], "phrase string, kind string")
    got = phrases.keyword_counts(docs, words)
    assert sorted(map(tuple, got.collect())) == [(1, 4, 1, 0.6), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert phrases._in_words(docs, [("aa", "positive", 1.0)]).count() == 2
    longer = words.unionByName(spark.createDataFrame([("a a", "negative")], words.schema))
    assert sorted(map(tuple, phrases.keyword_counts(docs, longer).collect()))[2] == (3, 0, 1, -1.0)

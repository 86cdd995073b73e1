"""Clashing columns, hot passages, repeated ids and extra columns."""

import random

from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, langid, linededup, quality, sharding


def test_result_columns_replace_input_columns(spark):
    rows = [(1, "a red fox ran over the hill", "x", 1, "m"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, items int, matches string")
    bench = spark.createDataFrame([(7, "red fox ran")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.matches(df, bench).collect()}
    assert (got[1].n_words, got[1]["items"], got[1].n_hit) == (7, ["7"], 3) and (got[2].n_words, got[2]["items"]) == (0, [])
    named = df.select("doc_id", "text", F.lit(5).alias("lang_pred"), F.lit("s").alias("score"), F.lit("q").alias("Slot"), F.lit(1).alias("n_lines"), F.lit("z").alias("n_removed"))
    model = langid.train(df.select("doc_id", "text", F.lit("en").alias("lang")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(named, model).collect()} == {1: "en", 2: "und"}
    assert all(isinstance(r.score, float) for r in quality.score(named, quality.train(df.select("doc_id", "text"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).collect())
    out = sharding.shard_documents(named, n_shards=2)
    assert [c.lower() for c in out.columns].count("slot") == 1 and out.count() == 2
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.dedup_lines(named).collect()} == {1: (1, 0), 2: (None, None)}


def test_lines_of_one_id_with_two_texts(spark):
    rows = [(1, "a\nb\nc"), (2, "x\ny\nz"), (2, "p\nq\nr"), (2, "a\nb\nc"), (None, "a\nb\nc"), (3, "x\ny\nz\nw"), (4, "p q r")]
    got = sorted((r.doc_id or -1, r.n_removed, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the null id stands first; the texts of id 2 that occur once stay whole
    assert got == sorted([(-1, 0, "a\nb\nc"), (1, 3, ""), (2, 0, "x\ny\nz"), (2, 0, "p\nq\nr"), (2, 3, ""), (3, 3, "w"), (4, 0, "p q r")])


def test_a_passage_in_every_document_goes_but_once(spark):
    r = random.Random(2)
    head = "\n".join(f"licence line {k}" for k in range(12))
    texts = [f"{head}\n" + "\n".join(f"own {i} {k} {r.random()}" for k in range(r.randint(1, 6))) for i in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert got[0].text == texts[0] and all(got[i].text == t[len(head) + 1 :] for i, t in enumerate(texts) if i)
    assert all(got[i].n_removed == 12 for i in range(1, 1500))


def test_very_long_texts(spark):
    long = "\n".join(f"line {i % 50_000}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "line 1\nline 2\nline 3")], "doc_id long, text string")
    got = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert got[1].n_lines == 200_000 and got[1].n_removed == 150_000 and got[2].n_removed == 3
    bench = spark.createDataFrame([(1, "line 49999 line 0 line 1")], "item_id long, text string")
    hit = {x.doc_id: x for x in decontam.matches(df, bench).collect()}
    assert hit[1].n_hit == 3 * 6 and hit[2].n_hit == 0


def test_chats_with_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 3, "t"), (1, 1, "assistant", "yo", None, None)], "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = chat.format_chats(df).collect()
    assert len(got) == 1 and got[0].n_turns == 2 and chat.read_turns(got[0].formatted) == [("user", "hi"), ("assistant", "yo")]

"""Small tests of every operator: brute force, odd rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, decontam, fingerprint, graph, html, jaccard, langid, linededup, mixing, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, pieces string, range int, slot int"
LONG = " ".join(f"word{i % 97} other{i}" for i in range(30_000))


def rows():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 60))) for _ in range(8)]
    out = []
    for i in range(60):
        words = base[i % 8].split()
        for _ in range(i % 5):
            words[r.randrange(len(words))] = r.choice(vocab)
        text = " ".join(words[:10]) + "\n" + " ".join(words[10:15]) + "\n" + " ".join(words[15:18]) + "\n" + " ".join(words[18:])
        out.append((i, text, ("en", "fr")[i % 2], ("a", "b", None)[i % 3], len(text), "x", "y", "z", "p", 1, 2))
    for i, text in enumerate([None, "", " \t\n", "One two", "ONE two", "\U0001f600 é ß ẞ", LONG, LONG, "12 34 !!", None]):
        out.append((100 + i, text, None if i % 2 else "en", "a", None, None, None, None, None, None, None))
    out.append(out[3])  # a repeated row
    out.append((None, "A row without an id or so it seems here", None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")


def bag(text):
    w = words(low(text))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else [])


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_jaccard(docs, empty):
    got = collections.defaultdict(set)
    for r in jaccard.jaccard_components(docs).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    sets = {k: set(bag(t)) for k, t in texts.items()}
    up = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert {k: {(len(sets[k]), up[k])} for k in sets} == {k: v for k, v in got.items() if k is not None}
    assert got[None] == {(6, None)}
    assert len(set(up.values())) < len(up) - 5
    kept = [r.doc_id for r in jaccard.drop_near_copies(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(k for k in up if up[k] == k) and kept.count(None) == 1
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.drop_near_copies(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([("b", rows()[0][1].upper()), ("c", "one, TWO"), ("d", None), ("e", ""), ("f", "no such words")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.matches(docs, bench).collect() if r.doc_id is not None}

    def tokens(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))

    for r in rows():
        if r[0] is None:
            continue
        w, hit, items = tokens(r[1]), set(), set()
        for item, text in (("b", rows()[0][1]), ("c", "one, TWO"), ("f", "no such words")):
            b = tokens(text)
            n = min(10, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items.add(item)
        g = got[r[0]]
        assert (g.n_words, g.n_hit, g["items"]) == (len(w), len(hit), sorted(items))
    first = got[0].matches[0]
    assert (first.doc_word, first.item_word, first.n_words) == (0, 0, len(tokens(rows()[0][1])))
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {k for k, g in got.items() if g.n_hit == 0} | {None}
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()
    # a benchmark searched in tables of any size finds the same, with items cut between tables, too
    many = spark.createDataFrame([(i, " ".join(rows()[i][1].split()[:25])) for i in range(12)], "item_id long, text string")
    whole, parts, cut = (sorted(map(str, decontam.matches(docs, many, block_words=n).collect())) for n in (1000, 100, 14))
    assert whole == parts == cut
    whole, parts = (sorted(map(str, decontam.decontaminate(docs, many, block_words=n).collect())) for n in (1000, 200))
    assert whole == parts and 0 < len(whole) < docs.count()


def test_decontaminate_with_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "a red fox and a blue hen"), (2, "a blue hen"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "red fox"), (None, "blue hen"), ("7", "blue hen"), (None, None), (None, "..")], "item_id string, text string")
    for n in (1000, 4):
        got = {r.doc_id: r for r in decontam.matches(docs, bench, block_words=n).collect()}
        assert [(got[k].n_hit, got[k]["items"]) for k in (1, 2, 3)] == [(4, [None, "7"]), (2, [None, "7"]), (0, [])]
        assert [m.item_id for m in got[1].matches] == [None, None, "7"]
        assert [r.doc_id for r in decontam.decontaminate(docs, bench, block_words=n).collect()] == [3]


def test_language(spark, docs, empty):
    text = {"en": "the quick brown fox and the lazy dog ", "fr": "où est la bibliothèque de l'école "}
    known = spark.createDataFrame([(i, text[k] * 3, k) for i, k in enumerate(["en", "fr"] * 10)], "doc_id long, text string, lang string")
    model = langid.train(known)
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("text", F.when(F.col("doc_id") == 5, text["fr"]).otherwise(F.col("text"))), model).collect()}
    assert got[5].lang_pred == "fr" and got[5].score > 0.9
    for k in (100, 101, 102, 108, 109):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[105].lang_pred in ("en", "fr") and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, langid.train(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0
    flags = {r.i: r.h for r in known.select(F.col("doc_id").alias("i"), langid.held_out("doc_id", 4, 2).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(20)}


def test_more_languages_than_a_block(spark):
    r = random.Random(5)
    text = {f"l{k:02}": " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(12)) for k in range(40)}
    rows = [(i, text[k], k) for i, k in enumerate(sorted(text) * 2)] + [(900, None, "l00"), (901, "12", "l01"), (902, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = langid.train(df), langid.train(df, block=7)
    assert len(one[0]) == 40 and isinstance(many, langid.Blocks)
    a, b = ({x.doc_id: x for x in langid.identify(df, m).collect()} for m in (one, many))
    assert all(a[i].lang_pred == k for i, _, k in rows[:80]) and (b[900].lang_pred, b[901].lang_pred) == ("und", "und")
    for i in a:
        assert a[i].lang_pred == b[i].lang_pred and a[i].score == pytest.approx(b[i].score, abs=1e-9)


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, n_shards=7).collect()
    again = sharding.shard_documents(docs.repartition(5), n_shards=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {r[0]: r[1] or "" for r in rows()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert len(got) == len(rows()) and sharding.shard_documents(empty).count() == 0


def test_communication_matrix_is_exact():
    m = sharding.communication_matrix([5, 0, 17, 30], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 30] and m.sum(axis=0).tolist() == [13] * 4
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.3)
    rng = np.random.default_rng(0)
    big = [sharding._draw(rng, 3_000_000_000, 1_000_000_000, 1000) for _ in range(200)]
    assert abs(np.mean(big) - 750) < 8


def test_mixing(docs, empty):
    got = mixing.mix(docs, n_shards=3).collect()
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    aim = mixing.targets(dict(sizes))
    assert abs(sum(aim.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(aim[s] <= 2 * sizes[s] for s in sizes)
    taken = collections.Counter()
    texts = {r[0]: r for r in rows()}
    for r in got:
        assert r.size == len(words(texts[r.doc_id][1])) and r.source_size == sizes[texts[r.doc_id][3]]
        assert abs(r.target - aim[texts[r.doc_id][3]]) < 1e-6 and r.taken == sum(p.n_words for p in r.pieces) <= 2 * r.size
        taken[texts[r.doc_id][3]] += r.taken
    assert all(abs(taken[s] - aim[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), n_shards=3).collect()))
    for s in range(3):  # shards get about the same
        assert abs(sum(p.n_words for r in got for p in r.pieces if p.shard == s) - sum(taken.values()) / 3) < 0.12 * sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def test_targets_reshare():
    assert mixing.targets({"a": 10, "b": 1000, None: 0}) == pytest.approx({"a": 20.0, "b": 1495.0, None: 0.0})
    assert mixing.targets({}) == {}
    split = mixing.splitting_tree(np.array([7, 0, 100]), 5, np.random.default_rng(1))
    assert split.sum(axis=0).tolist() == [7, 0, 100] and max(split.sum(axis=1)) - min(split.sum(axis=1)) <= 1


def test_lines(spark, empty):
    t = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nq\nq\nq\nq"), (4, None), (5, ""), (6, "a\nb"), (7, "a\nb\nc\nd"), (8, "k\n\n\nl")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.dedup_lines(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert got == {1: (4, 0, "a\nb\nc\nd"), 2: (5, 3, "x\ny"), 3: (7, 6, "q"), 4: (None, None, None), 5: (1, 0, ""), 6: (2, 0, "a\nb"), 7: (4, 4, ""), 8: (4, 0, "k\n\n\nl")}
    assert linededup.dedup_lines(empty).count() == 0


def test_line_rows_without_id_or_repeated(docs):
    assert linededup.dedup_lines(docs).count() == docs.count()


def test_fingerprints(docs, empty):
    got = fingerprint.fingerprints(docs.where("doc_id <> 3 or doc_id is null")).collect()
    texts = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows() if r[0] != 3))
    mine = {-1 if r.doc_id is None else r.doc_id: r for r in got}
    assert len(got) == len(texts) and len({(t, mine[i].fingerprint) for i, t in texts}) == len({t for _, t in texts})
    error = []
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        assert mine[i].n_chars == len(t) and mine[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, mine[i].near_edited), (after, mine[i].near_next)):
            a, b = bag(t), bag(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            assert abs(near - true) < 0.3
            error.append(near - true)
    assert abs(np.mean(error)) < 0.03
    assert fingerprint.fingerprints(empty).count() == 0
    assert fingerprint.fingerprints(docs).count() == docs.count()


def test_weighted_samples_follow_counts():
    a, b = ["x y z v w " * n + "x y z v" for n in (1, 3)]
    s = fingerprint.signatures([a, b])
    x, y = bag(a), bag(b)
    assert abs((s[0] == s[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.2


def test_fingerprint_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_OF_RANGE", 7)
    monkeypatch.setattr(fingerprint, "CUTS", 4)
    t = [(i * 3, f"text number {i} of the set with words {i * i}") for i in range(100)]
    got = sorted(fingerprint.fingerprints(spark.createDataFrame(t, "doc_id long, text string")).collect())
    assert [r.doc_id for r in got] == [i for i, _ in t]
    for k, r in enumerate(got):
        x, y = t[k][1], t[(k + 1) % 100][1]
        assert r.edited_sha256 == hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><p>Site name, hello.</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<div id="main"><article><h1>Head &amp; shoulders</h1><p>One  long\n paragraph, with words; and more words. It goes on, and on.<p>Two <b>bold</b> &lt;words&gt;, here. Again<br>more.
<form><input name=q>Search here</form><p>End.</p></article><section class="comments"><p>I disagree, strongly, with all of this. Really, I do.</p></section></div>
<aside>Side, side.</aside><footer>Foot, foot.</footer></body></html>"""


def test_html(spark):
    want = "Head & shoulders\nOne long paragraph, with words; and more words. It goes on, and on.\nTwo bold <words>, here. Again more.\nEnd."
    pages = [(1, "u", PAGE, "t"), (2, None, None, None), (3, "", "", ""), (4, "u", "<p>unclosed <b>and <i>crossed</b> tags.</i> <td", "t"), (5, "u", "<<<>>> & &amp; &nosuch;", ""), (6, "u", "<article>" + "<p>Word, word.</p>" * 5000, ""), (1, "u", PAGE, "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html.extract_pages(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 7 and by[1] == want and by[2] == by[3] == "" and by[4].startswith("unclosed and crossed tags.") and by[6].count("\n") == 4999
    assert all(r.n_chars == len(r.text) for r in got) and html.extract_pages(df.limit(0)).count() == 0
    assert html.extract_pages(df.select("html")).columns == ["text", "n_chars"]


def test_html_keeps_all_sections_and_pages_with_marked_wrappers():
    body = "".join(f"<p>Sentence {k} is long enough, with commas, to be text. It goes on.</p>" for k in range(40))
    lines = [f"Sentence {k} is long enough, with commas, to be text. It goes on." for k in range(40)]
    nested = f"<body><nav>Menu</nav><article><h1>Head</h1><p>The lead, short.</p><section>{body}</section><section><p>Closing part, short.</p></section></article></body>"
    assert html.extract(nested).split("\n") == ["Head", "The lead, short.", *lines, "Closing part, short."]
    for a, z in (("<main class='content has-sidebar'>", "</main>"), ("<div id='page' class='no-sidebar share-enabled'>", "</div>"), ("<div class='has-sidebar'><article>", "</article></div>")):
        got = html.extract(f"<body>{a}<h1>Head</h1>{body}<div class='sidebar'>Other, things.</div>{z}<div class='ad'>Buy, now.</div></body>")
        assert got.split("\n") == ["Head", *lines]
    assert html.extract(f"<body><article><h1>Head</h1><p>Short, text.</p></article><div class='ad'>{body}</div></body>") == "Head\nShort, text."


def test_quality(spark, docs, empty):
    r = random.Random(2)
    data = [(i, " ".join(r.choice("good fine well nice solid".split() if i % 2 else "bad*** poor!! worse### ugly@@".split()) for _ in range(30)), i % 2) for i in range(200)]
    known = spark.createDataFrame(data, "doc_id long, text string, quality int")
    weights = quality.train(known.select("doc_id", "text"), known.select("doc_id", "quality"))
    got = quality.score(known, weights).collect()
    assert all((x.score > 0.5) == (x.quality == 1) for x in got)
    assert {x.score for x in quality.score(empty.unionByName(docs), quality.train(docs, known.limit(0))).collect()} == {0.5}
    odd = {x.doc_id: x.score for x in quality.score(docs, weights).collect()}
    assert odd[100] == odd[101] == odd[102] and all(0 <= s <= 1 for s in odd.values())


def test_chat(spark):
    odd = "</s>[INST] \\ <|turn|>user<|says|> \\<|end|>\n[/INST]"
    t = [(1, 0, "system", "be"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "assistant", None), (2, None, None, "x"), (2, 0, "<|end|>", "y"), (None, 0, "assistant", ""), (1, 1, "user", odd)]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    full = {r.conv_id: r for r in chats.collect()}
    assert chat.read_turns(full[1].formatted) == [("system", "be"), ("user", odd), ("user", odd), ("assistant", odd), ("assistant", "")]
    assert [s.start for s in full[1].spans][1:] == [s.stop for s in full[1].spans][:-1] and not full[1].rewrites_history
    assert got[1].loss_chars == len(odd) and got[1].loss_sha256 == hashlib.sha256(odd.encode()).hexdigest() and got[2].loss_chars == 0
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx\n<|end|>\ny\n").hexdigest() and got[None].n_turns == 1
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_chat_finds_templates_that_rewrite_history():
    def last_only(turns):  # drops earlier assistant texts
        return "".join(f"<{r}>{'' if r == 'assistant' and k + 1 < len(turns) else t}\n" for k, (r, t) in enumerate(turns))

    out, spans = chat.render([("user", "hi"), ("assistant", "hello"), ("user", "bye")], last_only)
    assert [s["rewrites"] for s in spans] == [False, False, True] and spans[1]["text_start"] is None
    turns = [(("user", "assistant")[i % 2], f"{i} \\ </s>" * (i % 4)) for i in range(75)]
    whole = chat.render(turns, chat.default_template, chunk=1000)
    assert chat.render(turns, chat.default_template, chunk=8) == whole and chat._by_chunks(turns, chat.default_template, 8) == (whole[0], chat._prefixes(turns, chat.default_template)[1])
    assert chat._by_chunks(turns, last_only, 8) is None and chat.render(turns, last_only, chunk=8) == chat.render(turns, last_only, chunk=1000)
    numbered = lambda turns: "".join(f"{k}:{r}:{t}\n" for k, (r, t) in enumerate(turns))
    assert chat._by_chunks(turns, numbered, 8) is None and chat.render(turns, numbered, chunk=8) == chat.render(turns, numbered, chunk=1000)
    out, spans = chat.render([("user", "hi"), ("assistant", "hello")], chat.default_template)
    assert out[spans[1]["text_start"] : spans[1]["text_stop"]] == "hello"


def test_chat_finds_rewrites_at_any_length():
    def summed(turns):
        return ("summary\n" if len(turns) in (20, 40) else "") + chat.default_template(turns)

    turns = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(50)]
    whole, spans = chat.render(turns, summed)
    assert [s["turn"] for s in spans if s["rewrites"]] == [19, 20, 39, 40] and whole == chat.default_template(turns)
    seen = []

    def watched(turns):
        seen.append(len(turns))
        return chat.default_template(turns)

    assert chat.render(turns, watched) == chat.render(turns, chat.default_template) and set(seen) == set(range(51))
    seen.clear()
    watched.append_only = True
    assert chat.render(turns, watched) == chat.render(turns, chat.default_template) and len(seen) < 120


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir)
        assert frame.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in out}
    comp = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert len({comp[i] for i in ids}) == len(ids)
    dirty = {r.doc_id for r in decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").collect()}
    assert not ids & dirty and len(out) >= len(ids) > 50
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1

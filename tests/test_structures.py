"""Operators of paths, packs, chunks, files and stores against plain Python on small inputs."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import chunks, decisions, ledger, statements
from quillspark.operators import packing, paths, stores
from quillspark.sources import files


def one(spark, values, kind, column):
    """Results of a column function over values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_strong_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(25 + 15 * seed)]
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    got = {x.node: x.component for x in paths.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_components_without_edges(spark):
    assert paths.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert [tuple(x) for x in paths.strong_components(spark.createDataFrame([(3, 3)], "src long, dst long")).collect()] == [(3, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_bounded_edges_are_the_greedy_ones(spark, seed):
    r = random.Random(seed)
    rows = {(a, b): float(r.randrange(6)) for a, b in ((r.randrange(9), r.randrange(9)) for _ in range(40)) if a < b}
    degree, want = {}, []
    for (a, b), s in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if degree.get(a, 0) < 2 and degree.get(b, 0) < 2 and len(want) < 7:
            want.append((a, b, s))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame([(a, b, s) for (a, b), s in rows.items()], "a long, b long, score double")
    assert [tuple(x) for x in paths.bounded_edges(df, 2, 7).collect()] == want


def test_ranked_paths_stop_where_no_edge_is_left(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 1, 5.0), (3, 4, 1.0), (4, 1, 9.0)], "src long, dst long, gain double")
    starts = spark.createDataFrame([(1, 0.0), (7, 0.0)], "start long, score double")
    got = {(x.start, tuple(x.path), x.score) for x in paths.ranked_paths(starts, e, 5, 2, [F.desc("gain"), "dst"], F.col("gain")).collect()}
    assert got == {(1, (1, 2), 1.0), (1, (1, 3, 4), 3.0), (7, (7,), 0.0)}


def test_terms_shared_by_too_many_make_no_pairs(spark):
    rows = [(i, "all") for i in range(6)] + [(0, "x"), (1, "x"), (0, "y"), (1, "y"), (2, "y")]
    got = {tuple(x) for x in paths.shared_term_pairs(spark.createDataFrame(rows, "item long, term string"), 5).collect()}
    assert got == {(0, 1, 2), (0, 2, 1), (1, 2, 1)}


def test_pack_takes_the_first_always(spark):
    df = spark.createDataFrame([(1, 1, 90), (1, 2, 5), (1, 3, 4), (2, 1, 6), (2, 2, 5), (2, 3, 4), (2, 4, None)], "k long, place long, t long")
    for always, want in ((True, {(1, 1), (2, 1), (2, 3)}), (False, {(1, 2), (1, 3), (2, 1), (2, 3)})):
        got = packing.pack(df, "k", "place", "t", 10, first_always=always).where("taken").collect()
        assert {(x.k, x.place) for x in got} == want


def test_chunkers(spark):
    assert one(spark, ["diff --git a b\n+x\ndiff --git c d\n", "no diff", "", None], "string", chunks.diff_chunks) == [["diff --git a b\n+x", "diff --git c d"], ["no diff"], [], []]
    assert one(spark, ["start\n2024-01-01 a\n more\nTraceback x\n2024-01-02Tb"], "string", chunks.log_chunks) == [["start", "2024-01-01 a\n more", "Traceback x", "2024-01-02Tb"]]
    assert one(spark, ["h\n\n" + "\n".join(map(str, range(41))), "h", "  \n", None], "string", chunks.table_chunks) == [["h\n" + "\n".join(map(str, range(40))), "h\n40"], ["h"], [], []]
    long = "\n".join(f"v{i}" for i in range(130))
    got = one(spark, [f"a: 1\n  x\nb {{\n{long}\nc: 2", "", None], "string", chunks.settings_chunks)
    assert [p.count("\n") + 1 for p in got[0]] == [2, 60, 60, 11, 1] and got[1:] == [[], []]
    text = " ".join(f"w{i}" for i in range(500))
    windows = one(spark, [text, "a  b\nc", "", None], "string", chunks.token_windows)
    assert [len(x.split()) for x in windows[0]] == [240, 240, 68] and windows[0][1].startswith("w216 ") and windows[1] == ["a  b\nc"] and windows[2] == [""]


def test_chat_chunks(spark):
    r = random.Random(1)
    texts = ["\n\n".join(" ".join(["w"] * r.randint(1, 90)) for _ in range(n)) for n in (1, 5, 6, 7, 30)] + ["", None, "\n\n \n\n"]

    def plain(text):
        turns = [b.strip() for b in re.split(r"\n{2,}", text or "") if b.strip()]
        out, now = [], []
        for t in turns:
            now.append(t)
            if len(now) >= 6 or sum(len(x.split()) for x in now) >= 180:
                out.append("\n\n".join(now))
                now = now[-1:]
        return out + (["\n\n".join(now)] if now else [])

    assert one(spark, texts, "string", chunks.chat_chunks) == [plain(t) for t in texts]


def test_word_chunks_of_long_texts_are_linear(spark):
    from quillspark.functions import text as T

    n = 200_000
    df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("t"))
    assert df.select(F.size(T.word_chunks(F.col("t"))).alias("n")).first().n == -(-(n - 180) // 140) + 1


def test_number_words(spark):
    said = {"dozen": 12, "two dozen": 14, "one hundred and five": 105, "hundred": 100, "three thousand twenty": 3020, "and": None, "": None, "six apples": None, "thousand": 1000}
    assert one(spark, list(said), "string", ledger.number_words) == [None if v is None else float(v) for v in said.values()]


def test_claims_of_oneself_and_decisions(spark):
    got = one(spark, ["I currently use a pen. I own two cats right now!", "nothing"], "string", lambda x: statements.stated_claims(x, F.lit("user")))
    assert [(c.predicate, c.object) for c in got[0]] == [("currently_uses", "a pen"), ("current_quantity", "two cats")] and got[1] == []
    note = one(spark, ["# T\nDECISION: go\nwhy: fast", "plain", None], "string", decisions.decision)
    assert tuple(note[0]) == ("go", "fast", 2, 3) and note[1:] == [None, None]


def test_ignored_paths_follow_file_patterns(spark):
    names = ["a.py", "src/a.py", "src/build/x.o", "build", "docs/b.md", "x/docs/b.md", "node/1", "srcs/q"]
    for patterns in (["*.py"], ["build/"], ["/docs"], ["docs/*"], ["?.md", "# x", "!y"], ["src"]):

        def plain(path):
            for p in (p.lstrip("/").rstrip("/") for p in patterns if p[0] not in "#!"):
                if fnmatch.fnmatch(path, p) or fnmatch.fnmatch(path, f"**/{p}") or path == p or path.startswith(p + "/") or "/" not in p and any(fnmatch.fnmatch(x, p) for x in path.split("/")):
                    return True
            return False

        assert one(spark, names, "string", lambda c: files.ignored(c, patterns)) == [plain(n) for n in names]


def test_files(spark):
    df = spark.createDataFrame([(1, "é".encode()), (2, "é".encode("cp1252")), (3, None), (4, b"\x81")], "i long, content binary")
    assert [(r.i, r.text, r.charset) for r in files.decoded(df).orderBy("i").collect()] == [(1, "é", "utf-8"), (2, "é", "cp1252"), (3, None, None), (4, "�", "cp1252")]
    rows = [("a/.env", "x"), ("a/k.pem", "x"), ("b.txt", ""), ("b.txt", None), ("b.txt", "x" * 11), ("b.txt", "a\0b"), ("b.txt", "%PDF-1"), ("b.txt", "ok")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, c string")
    got = [r.y for r in df.select("i", files.rejection(F.col("p"), F.col("c"), 10).alias("y")).orderBy("i").collect()]
    assert got == ["secret", "secret", "empty", "empty", "too_large", "binary", "archive", None]
    assert one(spark, ['["a", 1]', '{"a": 1}', "[", None, "[]"], "string", files.json_list) == [["a", "1"], [], [], [], []]
    assert one(spark, ["insert into T select * from S join t", "x"], "string", files.sql_tables) == [["T", "S", "t"], []]


def test_stores(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k long, m string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, m string")
    got = {tuple(r) for r in stores.apply_snapshot(a, b, "k", "m", F.lit(True)).collect()}
    assert got == {(1, "x", "active"), (2, "x", "superseded"), (2, "y", "active"), (3, "x", "removed"), (4, "z", "active")}
    assert {tuple(r) for r in stores.apply_snapshot(a, b, "k", "m", F.lit(False)).collect()} == {(k, "x", "active") for k in (1, 2, 3)}
    r = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 20.0), ("b", 2, 5.0)], "k string, s int, v double")
    g = spark.createDataFrame([("a", 2.0), ("a", 0.5), ("a", 9.0), ("a", 3.0), ("b", 7.0)], "k string, guess double")
    assert {tuple(x) for x in stores.interpolated(r, g, "k", "s", "v").collect()} == {("a", 2.0, 15.0), ("a", 0.5, 10.0), ("a", 9.0, 20.0), ("a", 3.0, 20.0), ("b", 7.0, 5.0)}


def test_windows_begin_at_the_first_hit(spark):
    from quillspark.streaming import windows

    seconds = {1: [0, 5, 9, 10, 19, 20, 45], 2: [3, 12, 13]}
    rows = [(u, 100 * u + i, f"2024-01-01 00:00:{s:02}", 2 if s % 2 else None) for u, v in seconds.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, bytes int").withColumn("ts", F.to_timestamp_ntz("ts")).repartition(3)
    got = {(r.event_id): (r.start.second, r.n, r.used, r.allowed) for r in windows.first_hit_windows(df, 10, 2).collect()}
    want = {}
    for u, v in seconds.items():
        start = None
        for i, s in enumerate(v):
            if start is None or s >= start + 10:
                start, n, used = s, 0, 0
            n, used = n + 1, used + (2 if s % 2 else 0)
            want[100 * u + i] = (start, n, used, n <= 2)
    assert got == want

"""Pages, imports and scan cycles on small inputs."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions.pages import cut_batch, split_pages
from quillspark.sources import importing
from quillspark.streaming import cycles, windows


def plain_pages(text, most):
    """The same cuts, each found by trying."""
    pages, held = [], ""
    first = True
    for line in (text or "").strip().splitlines():
        candidate = line if first else f"\n{line}"
        if len(candidate.encode()) > most:
            pages.append(held)
            held, first = "", True
            rest = line.strip()
            while rest:
                end = min(len(rest), most)
                while end > 1 and len(rest[:end].encode()) > most:
                    end -= 1
                pages.append(rest[:end])
                rest = rest[end:].strip()
        elif not first and len((held + candidate).encode()) > most:
            pages.append(held)
            held, first = line, False
        else:
            held, first = held + candidate, False
    pages.append(held)
    return [p.strip() for p in pages if p.strip()]


def test_pages():
    r = random.Random(6)
    for _ in range(400):
        text = "".join(r.choice(["a", "é", "漢", "\U0001f600", " ", "\n", "  ", "word ", "　"]) for _ in range(r.randint(0, 120)))
        for most in (3, 7, 16, 40):
            got = split_pages(text, most)
            assert got == plain_pages(text, most), (text, most)
            assert all(len(p.encode()) <= max(most, 4) for p in got)
    assert split_pages(None) == [] and split_pages(" \n ") == []
    long = "x" * 3_000_000
    assert [len(p) for p in split_pages(long)] == [262144] * 11 + [3_000_000 - 11 * 262144]


def test_a_folder_is_imported_in_batches_and_once(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    made = {"a.txt": b"Hello\n", "b.MD": "# é".encode(), "deep/c.py": b"x = 1\n" * 3, "d.bin": b"\0", "e.log": b"  \n", "f.txt": "caf\xe9".encode("cp1252"), "g.pdf": b"%PDF", "h.txt": b"y" * 99}
    for name, raw in made.items():
        (folder / name).write_bytes(raw)
    base = str(tmp_path)

    def run():
        windows.run_once(importing.imported(importing.folder_stream(spark, str(folder), 2), 8, 50), f"{base}/out", f"{base}/at")
        rows = spark.read.parquet(f"{base}/out").collect()
        return {x.path.split("/in/")[1]: (x.reader, x.outcome, x.charset, list(x.pages or [])) for x in rows}, len(rows)

    got, n = run()
    assert n == 8 and got == {
        "a.txt": ("text", "imported", "utf-8", ["Hello"]), "b.MD": ("markdown", "imported", "utf-8", ["# é"]), "deep/c.py": ("code", "imported", "utf-8", ["x = 1", "x = 1", "x = 1"]), "d.bin": (None, "unsupported", None, []),
        "e.log": ("text", "empty", "utf-8", []), "f.txt": ("text", "imported", "cp1252", ["café"]), "g.pdf": ("pdf", "unsupported", None, []), "h.txt": ("text", "too_large", None, []),
    }
    (folder / "new.txt").write_bytes(b"more")
    got, n = run()
    assert n == 9 and got["new.txt"][1] == "imported"


def test_tombstones_wait_for_a_whole_cycle(spark, tmp_path):
    state = str(tmp_path / "state")
    listing = lambda names: spark.createDataFrame([(n,) for n in names], "path string")
    all_ = [f"p{i}" for i in range(7)]
    assert [cycles.step(spark, listing(all_), state, 3) for _ in range(4)] == [(0, "discovery", 3), (0, "discovery", 3), (0, "discovered", 1), (0, "tombstone", 0)]
    some = [n for n in all_ if n not in ("p0", "p6")]
    assert cycles.step(spark, listing(some), state, 3) == (1, "discovery", 3)
    assert {x.path for x in cycles.sources(spark, state).where("status = 'missing'").collect()} == set()  # the cycle is not over
    assert [cycles.step(spark, listing(some), state, 3) for _ in range(2)] == [(1, "discovered", 2), (1, "tombstone", 2)]
    assert {x.path: x.status for x in cycles.sources(spark, state).collect()} == {n: "missing" if n in ("p0", "p6") else "present" for n in all_}
    # a step whose last line was never written is done again
    spark.createDataFrame([("zz", "present", 99)], "path string, status string, step long").write.parquet(f"{state}/sources/part=99")
    assert cycles.sources(spark, state).where("path = 'zz'").count() == 0
    assert cycles.step(spark, listing([]), state, 3) == (2, "discovered", 0) and cycles.step(spark, listing([]), state, 3) == (2, "tombstone", 5)


def test_texts_of_a_batch_are_not_held_at_once():
    texts = pa.array([None, "", " a \n b"] + [f"{k} " + "word line\n" * 1000 for k in range(1500)])
    tracemalloc.start()
    got = cut_batch(texts, 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [split_pages(t, 4000) for t in texts.to_pylist()] and got.type == pa.list_(pa.string())
    assert peak < 6_000_000  # 15 MB of texts and as much of pages before
    assert len(cut_batch(texts.slice(0, 0))) == 0

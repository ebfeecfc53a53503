"""Answers in pieces, silent runs, summary ranges, and changes of files: the same results for any batches."""

from __future__ import annotations

import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from folio.operators.guard import media_pattern, neutralise_media
from folio.sources import changes
from folio.storage import new_folder
from folio.streaming import answers, runs
from folio.streaming import events as S


def _stream(spark, rows, schema, path, files):
    """Rows in the given order, in so many files, one a batch."""
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        for name in os.listdir(f"{path}/{i:03d}"):
            os.utime(f"{path}/{i:03d}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


TEXTS = [
    "plain", "", "![a](https://bad.example/x.png) tail", "![a](https://ok.example/x.png)![b](http://bad.example:80/y?z#w)", "![x](/assets/1) ![ ![y](https://bad.example/1)", "!![![", "ends with ![a](https://bad.exam",
    "a ![" + "n" * 700 + "](https://bad.example/long) ![s](https://bad.example/s)", "![a](ftp://x) ![b](https://)", "[[IMG:a1]] and ![t](https://bad.example/p.png)!",
]


def test_every_cut_gives_the_same_text():
    pattern = regex.compile(media_pattern(("ok.example",)))
    rnd = random.Random(1)
    for text in TEXTS:
        want = None
        for trial in range(60):
            tail, out, at = "", [], 0
            while at < len(text) or at == 0:
                step = len(text) + 1 if trial == 0 else 1 if trial == 1 else rnd.randint(1, 40)
                parts, tail = answers.cut_marks(pattern, tail + text[at : at + step], at + step >= len(text))
                out += parts
                at += step
                if at >= len(text):
                    break
            got = "".join(f"<{m}>" if m else t for t, m in out) + tail
            want = got if want is None else want
            assert got == want and tail == ""
            assert "".join(t for t, _ in out) == text


@pytest.mark.parametrize("files", [1, 3])
def test_media_streams_like_the_batch_form(spark, tmp_path, files):
    schema = "answer long, seq long, text string, last boolean"
    rows = []
    for i, text in enumerate(TEXTS):
        pieces = [text[k : k + 1 + i] for k in range(0, len(text), 1 + i)] or [""]
        rows += [(i, k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    random.Random(2).shuffle(rows)  # pieces ahead of their turn wait
    rows += rows[:20]  # and those that come again count once
    found = answers.whole(S.run_to_end(answers.media_stream(_stream(spark, rows, schema, tmp_path, files), ("ok.example",))))
    got = {r.answer: r.text for r in found.collect()}
    short = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if len(t) < 600], "answer long, text string")
    want = {r.answer: r.text for r in short.select("answer", neutralise_media(F.col("text"), ("ok.example",)).alias("text")).collect()}
    assert {i: t for i, t in got.items() if i in want} == {i: t for i, t in want.items() if t}
    assert got[7].startswith("a ![nnn") and got[7].endswith("(https://bad.example/long) [远程图片已中和：bad.example]")  # no mark is longer than 600 characters


def test_pieces_of_a_batch_are_taken_together(spark, tmp_path):
    """An answer's pieces travel and are sent on as runs, not one row each, whatever answers stand between them."""
    rows = [(i, k, "ab", k == 299) for k in range(300) for i in range(5)]
    found = S.run_to_end(answers.media_stream(_stream(spark, rows, "answer long, seq long, text string, last boolean", tmp_path, 2)))
    assert found.count() == 10 and {r.answer: r.text for r in answers.whole(found).collect()} == {i: "ab" * 300 for i in range(5)}


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_runs_that_overlap(spark, tmp_path, batch):
    """Pieces in any order, some twice, some without text or number, over a batch of rows and a micro-batch; what comes after the last piece is dropped."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rnd = random.Random(batch)
        text = {i: "".join(rnd.choice(["x", "语", "[[IMG:a1]]", "[[IMG:", "!"]) for _ in range(rnd.randint(0, 60))) for i in range(12)}
        rows = []
        for i, whole in text.items():
            cuts = [whole[k : k + 3] for k in range(0, len(whole), 3)] + [None]
            rows += [(f"a{i}" if i else None, k, p, k == len(cuts) - 1) for k, p in enumerate(cuts)] + [(f"a{i}", len(cuts), "late", True), (f"a{i}", None, "?", True), (f"a{i}", -1, "?", False)]
        rows = [r for r in rows if r[0] or r[1] is not None]
        rows += rnd.sample(rows, len(rows) // 2)
        rnd.shuffle(rows)
        found = S.run_to_end(answers.cut_stream(_stream(spark, rows, "answer string, seq long, text string, last boolean", tmp_path, 4), answers.MARK))
        got = {r.answer: r.text for r in answers.whole(found).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(f"a{i}" if i else None): t for i, t in text.items() if t}


def _ended(rows, after, now):
    out = {}
    by = {}
    for run, second, answer in rows:
        by.setdefault(run, []).append((second, answer))
    for run, events in by.items():
        last, n = None, 0
        for second, answer in sorted(events, key=lambda e: (e[0], not e[1])):
            if last is not None and second - last > after:
                out[run] = ("interrupted", n)
                break
            last, n = second, n + 1
            if answer:
                out[run] = ("finished", n)
                break
        else:
            if now - last > after:
                out[run] = ("interrupted", n)
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_silent_runs_end_by_a_timer(spark, tmp_path, files):
    rnd = random.Random(3)
    rows = sorted(((rnd.randint(0, 30), 1_000_000 + rnd.randint(0, 5000), rnd.random() < 0.1) for _ in range(300)), key=lambda r: r[1])
    schema = "run_id long, second long, answer boolean"
    stream = _stream(spark, rows, schema, tmp_path, files).withColumn("ts", F.timestamp_seconds("second"))
    got = {r.run_id: (r.status, r.n_events) for r in S.run_to_end(runs.ended_runs(stream, after=600.0)).collect()}
    assert got == _ended(rows, 600, rows[-1][1]) and {s for s, _ in got.values()} == {"finished", "interrupted"}


@pytest.mark.parametrize("files", [1, 5])
def test_summary_ranges(spark, tmp_path, files):
    rnd = random.Random(4)
    rows = [(s, t, "x" * rnd.randint(0, 300)) for t in range(40) for s in range(4)]
    got = sorted(map(tuple, S.run_to_end(runs.summary_ranges(_stream(spark, rows, "session long, turn long, text string", tmp_path, files), F.length("text"), 1000, 3)).select("session", "idx_from", "idx_to").collect()))
    want = []
    for s in range(4):
        first, total = 0, 0
        costs = [len(t) for a, _, t in rows if a == s]
        for i, c in enumerate(costs):
            total += c
            if total >= 1000 and i - first + 1 > 3:
                want.append((s, first, i - 3))
                total -= sum(costs[first : i - 2])
                first = i - 2
    assert got == sorted(want) and want


def _write(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_file_changes_with_a_restart(spark, tmp_path):
    vault, log, state = tmp_path / "vault", f"file://{tmp_path}/listings", f"file://{tmp_path}/state"
    out = new_folder(spark, "changes")
    _write(vault / "a.md", "one", 1000)
    _write(vault / "sub/b.md", "two", 1000)
    _write(vault / ".hidden/c.md", "no", 1000)
    _write(vault / "d.txt", "no", 1000)
    _write(vault / "Skip/e.md", "no", 1000)

    def start():
        stream = changes.file_changes(spark, f"file://{vault}", log, ignored=("skip",))
        return stream.writeStream.option("checkpointLocation", state).trigger(processingTime="1 second").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()

    query = start()
    query.processAllAvailable()
    _write(vault / "a.md", "one and more", 2000)
    (vault / "sub/b.md").unlink()
    _write(vault / "f.md", "new", 2000)
    changes.drain(query)
    assert not query.isActive
    _write(vault / "g.md", "while nobody looks", 3000)
    (vault / "f.md").unlink()
    changes.drain(start())
    changes.drain(start())  # nothing has changed
    rows = [(r.batch, r.path, r.op, r.size) for r in spark.read.parquet(out).collect()]
    first = min(b for b, *_ in rows)
    assert sorted(x[1:] for x in rows if x[0] == first) == [("a.md", "add", 3), ("sub/b.md", "add", 3)]
    assert sorted((p, o) for b, p, o, _ in rows if b != first) == [("a.md", "modify"), ("f.md", "add"), ("f.md", "delete"), ("g.md", "add"), ("sub/b.md", "delete")]


def test_a_batch_begun_again_has_the_same_rows(tmp_path):
    vault = tmp_path / "vault"
    _write(vault / "a.md", "one", 1000)
    reader = changes.ChangeReader({"path": f"file://{vault}", "listings": f"file://{tmp_path}/log"})
    start, end = reader.initialOffset(), reader.latestOffset()

    def rows():
        return [r for p in reader.partitions(start, end) for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    before = rows()
    (vault / "a.md").unlink()
    assert reader.latestOffset() == {"listing": 1}
    reader.commit(end)
    assert rows() == before == [("a.md", "add", 3, 1000.0)]

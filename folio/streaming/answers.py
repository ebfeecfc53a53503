"""Answers rewritten while they stream: marks that come in pieces are held back until they are whole.

A stream has rows (answer, seq, text, last): pieces of an answer, numbered from 0. Whatever the pieces, the output of an answer is the same:
a state for each answer holds the tail that may be the beginning of a mark, found by matching the pattern in part, and pieces that came
before their turn. A mark longer than ``MOST`` characters isn't one, so no more than that is ever held back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folio.operators.answers import MARK
from folio.operators.guard import MEDIA_NOTE, media_pattern

# Fixed value: the characters after which an opened mark is let through.
MOST = 600
#: Characters that are looked through at once: a mark that never closes is looked for no further. The turn of an answer that has ended.
STEP, OVER = 4096, 1 << 62
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut_marks(pattern: regex.Pattern, text: str, ended: bool, most: int = MOST) -> tuple[list[tuple[str, str | None]], str]:
    """([(plain text or whole mark, the mark's first group or null)], held tail) of what is known of an answer so far."""
    out: list[tuple[str, str | None]] = []
    done = start = 0  # what is before ``done`` is out; before ``start`` no mark begins any more
    while True:
        found = pattern.search(text, start, partial=not ended)
        if found is None or found.start() == len(text):
            break
        if found.partial and len(text) - found.start() <= most:
            out.append((text[done : found.start()], None))
            return [x for x in out if x[0]], text[found.start() :]
        if found.partial or len(found.group()) > most:
            start = found.start() + 1
            continue
        out += [(text[done : found.start()], None), (found.group(), found.group(1))]
        done = start = found.end()
    out.append((text[done:], None))
    return [x for x in out if x[0]], ""


def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (answer, seq, text, last), the pieces of a batch that follow each other in their answer become one row (answer, seq, text, sizes, last): the first one's
    number, their text in one, how many characters each has, and whether the answer ends with them. So a run of pieces is shuffled and met by Python as one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        answer, seq, text, last = batch.columns
        code = pc.fill_null(answer.dictionary_encode().indices, -1).to_numpy()
        order = np.lexsort((seq.to_numpy(), code))  # of equal pieces the first one stays first
        code, number, ends = code[order], seq.to_numpy()[order], last.to_numpy(zero_copy_only=False)[order]
        starts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(number) != 1) | ends[:-1]))
        bounds = np.append(starts, len(order)).astype(np.int32)
        pieces = text.take(pa.array(order))
        sizes = pc.utf8_length(pieces).cast(pa.int32())
        columns = [answer.take(pa.array(order[starts])), pa.array(number[starts]), pc.binary_join(pa.ListArray.from_arrays(bounds, pieces), ""), pa.ListArray.from_arrays(bounds, sizes), pa.array(ends[bounds[1:] - 1])]
        yield pa.record_batch(columns, names=["answer", "seq", "text", "sizes", "last"])


class _Held(StatefulProcessor):
    """State of an answer: the next piece's number, how many rows it has sent, and its tail; pieces ahead of their turn by their number."""

    def __init__(self, pattern: str, most: int) -> None:
        self.pattern, self.most = pattern, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "seq long, sent long, tail string")
        self.ahead = handle.getMapState("ahead", "seq long", "text string, last boolean")
        self.compiled = regex.compile(self.pattern)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        known = self.now.get()
        turn, sent, tail = known or (0, 0, "")
        if turn == OVER:
            return
        runs = sorted(((r.seq, r.text, r.sizes, r.last) for r in rows if r.seq + len(r.sizes) > turn), key=lambda r: r[0])
        told: list[tuple[str, str | None]] = []
        ended, at = False, 0
        while not ended:
            if at < len(runs) and runs[at][0] <= turn:
                seq, text, sizes, last = runs[at]
                at += 1
                if seq + len(sizes) <= turn:  # pieces that come again count once
                    continue
                text, turn, ended = text[sum(sizes[: turn - seq]) :], seq + len(sizes), last
            elif known and self.ahead.containsKey((turn,)):  # nothing waits for an answer that is new
                text, ended = self.ahead.getValue((turn,))
                self.ahead.removeKey((turn,))
                turn += 1
            else:
                break
            for k in range(0, max(1, len(text)), STEP):
                parts, tail = cut_marks(self.compiled, tail + text[k : k + STEP], ended and k + STEP >= len(text), self.most)
                told += parts
        if ended:
            if known:
                self.ahead.clear()
            self.now.update((OVER, sent + len(told), ""))  # further pieces of an answer that has ended are dropped
        else:
            waiting: dict[int, tuple[str, bool]] = {}
            for seq, text, sizes, last in runs[at:]:
                done = 0
                for i, size in enumerate(sizes):
                    waiting.setdefault(seq + i, (text[done : done + size], last and i == len(sizes) - 1))
                    done += size
            for seq, piece in waiting.items():
                self.ahead.updateValue((seq,), piece)
            self.now.update((turn, sent + len(told), tail))
        for i, (text, mark) in enumerate(told):
            yield Row(answer=key[0], n=sent + i, text=text, mark=mark)

    def close(self) -> None:
        pass


def cut_stream(pieces: DataFrame, pattern: str, most: int = MOST) -> DataFrame:
    """(answer, n, text, mark): the answers' text in order of ``n``, each whole mark a row of its own, whose first group is ``mark``.

    A null text counts as empty, and an answer whose ``last`` piece never comes keeps its tail. Pieces are put together within their task (``in_runs``) before they
    are shuffled by answer. A hot answer's pieces are one key's rows: the runs of a micro-batch are taken together, and only pieces ahead of their turn are kept. Needs the
    RocksDB state store, which is set for the session."""
    pieces.sparkSession.conf.set(STORE, ROCKS)
    kind = dict(pieces.dtypes)["answer"]
    rows = pieces.select("answer", F.col("seq").cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("last", F.lit(False)).alias("last")).where("seq IS NOT NULL")
    joined = rows.mapInArrow(in_runs, f"answer {kind}, seq long, text string, sizes array<int>, last boolean")
    return joined.groupBy("answer").transformWithState(_Held(pattern, most), f"answer {kind}, n long, text string, mark string", "append", "none")


def media_stream(pieces: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """(answer, n, text): remote images of hosts that aren't allowed become a note, as in ``guard.neutralise_media``."""
    found = cut_stream(pieces, media_pattern(allow))
    return found.select("answer", "n", F.when(F.col("mark").isNull(), F.col("text")).otherwise(F.replace(F.lit(MEDIA_NOTE), F.lit("$1"), F.col("mark"))).alias("text"))


def image_stream(pieces: DataFrame, assets: DataFrame) -> DataFrame:
    """(answer, n, text): image marks become images where the asset is known, and go where it isn't, as in ``answers.replace_marks``. assets: asset_id, img_url, alt."""
    found = cut_stream(pieces, MARK).join(assets.select(F.col("asset_id").alias("mark"), "img_url", "alt"), "mark", "left")
    image = F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), "img_url", F.lit(")"))
    return found.select("answer", "n", F.when(F.col("mark").isNull(), F.col("text")).otherwise(F.coalesce(image, F.lit(""))).alias("text"))


def whole(rows: DataFrame) -> DataFrame:
    """(answer, text): what a stream sent of each answer, put together."""
    return rows.groupBy("answer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))


def in_pieces(answers: DataFrame, size: Column, answer: str = "answer", text: str = "text") -> DataFrame:
    """(answer, seq, text, last): texts cut after every ``size`` characters; an empty text is one piece."""
    rows = answers.select(F.col(answer).alias("answer"), F.coalesce(text, F.lit("")).alias("__text"), F.greatest(size, F.lit(1)).cast("int").alias("__size"))
    n = F.greatest(F.ceil(F.length("__text") / F.col("__size")), F.lit(1)).cast("int")
    cut = rows.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return cut.select("answer", F.col("__i").cast("long").alias("seq"), F.substr("__text", F.col("__i") * F.col("__size") + 1, F.col("__size")).alias("text"), (F.col("__i") == F.col("__n") - 1).alias("last"))

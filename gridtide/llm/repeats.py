"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over ``K`` bytes triggers the phrases: the first smallest hash within a string of ``length`` bytes is
its trigger, and consecutive starts with one trigger make a phrase, which reaches from the first of them to the end of
the last one's string. Phrases so overlap by all but the starts, none is a prefix of another occurrence's rest, and two
equal strings have equal triggers. The dictionary is the set of distinct phrases; the parse is the list of (document,
start, phrase). Their order, by trigger, phrase, document and start, is built by Spark's exchange and sort: suffixes
that agree in the ``length`` bytes that matter meet in it, the earliest first.

* A phrase that occurred earlier repeats all its strings: no byte of it is looked at again.
* A phrase whose trigger has no other phrase repeats none.
* Where one trigger has several phrases (at the edges of repeats), their first occurrences are cut into stretches of
  ``width`` starts, aligned to the trigger, which are judged in the same way by the bytes that all their strings share.
* What is open after that, the strings of a few stretches at each edge, is put in order string by string.

Each task first merges the equal phrases and digests of its own, so that a passage shared by a great many documents is
one row a task. Phrases and strings are compared by two hashes of 64 bits.

Cases: null texts are empty; texts shorter than ``length`` keep all; a null doc_id counts as smaller than all others;
rows that share an id are versions of one document, and each loses the bytes repeated in any of them; texts of any
length are read in segments of :data:`SEGMENT` starts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import saved, table

K = 24
SEGMENT = 1_000_000
CHUNK = 1_500_000
POSITION = 22  # bits for a place within a chunk
MERGED = 500_000  # phrases that a task merges at a time
NO_ID = -(2**63)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums of its powers modulo 2^64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        known = Rolling.powers.get(base)
        if known is None or len(known[0]) < len(data) + 1:
            n = max(len(data) + 1, 1 << 20)
            up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            known = Rolling.powers[base] = (np.cumprod(up), np.cumprod(down))
        self.down = known[1]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * known[0][: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def each(self, size: int) -> np.ndarray:
        """Of every substring of size bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def smallest(v: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each window of size values."""
    width = 1
    while 2 * width <= size:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (size - width)], v[size - width :]) if size > width else v


def segments(texts: list[bytes], length: int, most: int):
    """Chunks of (text number, offset, bytes); each start of a string of length bytes is in one segment."""
    chunk, size = [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), most):
            part = text[a : a + most + length - 1]
            if len(part) < length:
                continue
            chunk.append((k, a, part))
            size += len(part)
            if size >= CHUNK:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def phrases(chunk: list[tuple[int, int, bytes]], length: int) -> dict[str, np.ndarray]:
    """trigger and phrase hashes, text number, start and number of starts of all phrases of a chunk."""
    data = np.frombuffer(b"".join(p for *_, p in chunk), np.uint8)
    first, second = Rolling(data, BASES[0]), Rolling(data, BASES[1])
    hashes = first.each(K)
    low = np.uint64((1 << POSITION) - 1)
    trigger = (smallest((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - K + 1) & low).astype(np.int32)
    size = np.array([len(p) for *_, p in chunk])
    begin = np.cumsum(size) - size
    starts = size - length + 1
    at = np.arange(starts.sum()) + np.repeat(begin - (np.cumsum(starts) - starts), starts)
    own = trigger[at]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
    n = np.diff(np.append(new, len(at)))
    which = np.searchsorted(begin, at[new], "right") - 1
    return {
        "trigger": hashes[own[new]],
        "phrase": second.of(at[new], at[new] + n + length - 1),
        "text": np.array([k for k, *_ in chunk])[which],
        "start": at[new] - begin[which] + np.array([a for _, a, _ in chunk])[which],
        "n": n,
        "at": own[new] - at[new],
    }


def merged(rows: dict[str, np.ndarray], by: tuple[str, str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """rows in order of by, doc and start, and whether each is a repeat of the one before."""
    order = np.lexsort((rows["start"], rows["doc"], rows[by[1]], rows[by[0]]))
    rows = {k: v[order] for k, v in rows.items()}
    same = np.concatenate(([False], (rows[by[0]][1:] == rows[by[0]][:-1]) & (rows[by[1]][1:] == rows[by[1]][:-1])))
    return rows, same


def runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching runs of starts of the same document as one."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n[:-1]))))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], start[last] + n[last] - start[new]


def _emitted(rows: dict, same: np.ndarray, by: tuple[str, str]):
    """Record batches of the first of each kind of row, and of the runs of repeats, which are known to go."""
    some = {k: v[~same] for k, v in rows.items()}
    doc, start, n = runs(rows["doc"][same], rows["start"][same], rows["n"][same])
    own = mixed(doc.view(np.uint64) * np.uint64(BASES[0]) + start.astype(np.uint64))  # any well spread value
    columns = [
        np.concatenate((some[by[0]], own)).view(np.int64),
        np.concatenate((some[by[1]], own)).view(np.int64),
        np.concatenate((some["doc"], doc)),
        np.concatenate((some["start"], start)),
        np.concatenate((some["n"], n)).astype(np.int32),
        np.concatenate((some["at"], np.zeros(len(doc), np.int64))).astype(np.int32),
        np.concatenate((np.zeros(len(some["doc"]), bool), np.ones(len(doc), bool))),
    ]
    for i in range(0, len(columns[0]), 50_000):
        yield pa.record_batch([pa.array(c[i : i + 50_000]) for c in columns], names=["a", "b", "doc", "start", "n", "at", "gone"])


ROW = "a long, b long, doc long, start long, n int, at int, gone boolean"


def parsed(docs: DataFrame, length: int, segment: int = SEGMENT) -> DataFrame:
    """The parse of docs (doc, text): trigger a, phrase b, doc, start, n starts; gone: a repeat within the task."""

    def task(batches):
        held, size = [], 0

        def flush():
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            yield from _emitted(*merged(rows, ("trigger", "phrase")), ("trigger", "phrase"))

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            ids = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for chunk in segments([t or b"" for t in texts], length, segment):
                rows = phrases(chunk, length)
                rows["doc"] = ids[rows.pop("text")]
                held.append(rows)
                size += len(rows["doc"])
                if size >= MERGED:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(task, ROW)


def stretches(start: np.ndarray, n: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of starts (at: from the first start to the trigger) cut where the way to the trigger is a multiple of width.

    Returns start, n and the place of the bytes that all strings of a stretch share, wherever it is cut.
    """
    way = np.repeat(at, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    first = np.repeat(start + at, n) - way
    of = np.repeat(np.arange(len(n)), n)
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (way[1:] // width != way[:-1] // width)))) if len(way) else np.zeros(0, np.int64)
    return first[new], np.diff(np.append(new, len(way))), first[new] + way[new] - way[new] // width * width


def closer(docs: DataFrame, length: int, width: int, segment: int = SEGMENT) -> DataFrame:
    """Stretches of the runs listed in docs (doc, text, own: start, n, at); with width 1, single strings.

    a is the hash of the bytes that all strings of a stretch share, b that of all its bytes; with width 1 both are of
    the one string, and by different bases.
    """

    def task(batches):
        held, size = [], 0

        def flush():
            rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            yield from _emitted(*merged(rows, ("shared", "all")), ("shared", "all"))

        for batch in batches:
            ids, texts, lists = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()), batch.column(2)
            for k in range(len(ids)):
                own, text = lists[k].values, texts[k].as_py() or b""
                start, n, at = (own.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "at"))
                fits = start + n + length - 1 <= len(text)
                start, n, core = stretches(start[fits], n[fits], at[fits], width)
                order = np.argsort(start, kind="stable")
                start, n, core = start[order], n[order], core[order]
                for a in range(0, len(text), segment):
                    some = slice(*np.searchsorted(start, (a, a + segment)))
                    if some.stop > some.start:
                        data = np.frombuffer(text[a : a + segment + 2 * length + width], np.uint8)
                        one, two = Rolling(data, BASES[0]), Rolling(data, BASES[1])
                        shared = one.of(core[some] - a, core[some] - a + length - width + 1)
                        whole = two.of(start[some] - a, start[some] - a + n[some] + length - 1)
                        zero = np.zeros(len(whole), np.int64)
                        ways = core[some] - start[some] if width > 1 else zero
                        held.append({"shared": shared, "all": whole, "doc": zero + ids[k], "start": start[some], "n": n[some], "at": ways})
                        size += len(whole)
                if size >= MERGED:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(task, ROW)


def judged(rows: DataFrame) -> DataFrame:
    """(doc, start, n, at, gone) of the rows that repeat an earlier one, and of those that meet another of their kind."""
    order, whole = Window.partitionBy("a").orderBy("b", "doc", "start"), Window.partitionBy("a")
    out = rows.withColumn("gone", F.col("gone") | F.coalesce(F.lag("b").over(order) == F.col("b"), F.lit(False)))
    out = out.withColumn("several", F.min("b").over(whole) != F.max("b").over(whole))
    return saved(out.where("gone or several").select("doc", "start", "n", "at", "gone"))


def by_doc(rows: DataFrame, most: int) -> DataFrame:
    """(doc, own: its runs), to be broadcast if there are no more than most runs, else to be merged with."""
    n = most + 1 if not most else rows.limit(most + 1).count()
    lists = rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "at")).alias("own"))
    return F.broadcast(lists) if n <= most else lists.hint("merge")


def repeats(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id", width: int = 8, most: int = 2_000_000, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, text, own): own lists the runs (start, n) of starts of strings of length bytes that start earlier too."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text).alias("text"))
    levels = [judged(parsed(rows, length, segment))]
    for size in (width, 1):
        near = by_doc(levels[-1].where("not gone"), most)
        levels.append(judged(closer(rows.join(near, "doc").select("doc", "text", "own"), length, size, segment)))
    gone = levels[0].where("gone").unionByName(levels[1].where("gone")).unionByName(levels[2].where("gone"))
    gone = by_doc(gone.select("doc", "start", "n", "at"), 0)  # most documents have some: always a shuffle of both sides
    return rows.join(gone, "doc", "left").select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "own")


def cut(text: bytes, starts: np.ndarray, n: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of text, and how many bytes in how many runs are removed."""
    cover = np.zeros(len(text) + 1, np.int32)
    inside = starts + length <= len(text)
    np.add.at(cover, starts[inside], 1)
    np.add.at(cover, np.minimum(starts[inside] + n[inside] + length - 1, len(text)), -1)
    removed = np.cumsum(cover[:-1]) > 0
    edges = np.diff(np.concatenate(([False], removed)).astype(np.int8))
    return np.frombuffer(text, np.uint8)[~removed].tobytes(), int(removed.sum()), int((edges == 1).sum())


def removed(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, kept: binary, n_bytes, n_removed, n_spans) of docs."""

    def task(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = []
            for text, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                runs_ = own.values
                text = text or b""
                out.append((text, 0, 0) if runs_ is None else cut(text, runs_.field("start").to_numpy(), runs_.field("n").to_numpy(), length))
            sizes = [len(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)]
            yield pa.record_batch([batch.column(0), columns[0], pa.array(sizes, pa.int64()), *columns[1:]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return repeats(docs, length).mapInArrow(task, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

The labelled sentences are the labelled texts, each a bag of strings of which the toxic ones hold at least one insult
(multiple-instance learning). A string is a whitespace-separated token without its punctuation (so that i.d.i.o.t is
one), with digits and signs that stand for letters read as letters, and runs of three and more single letters joined;
letters of all scripts count, those outside Latin-1 by one of 32 numbers. A run of more than :data:`LONGEST` letters,
as scripts without blanks have them, is read in overlapping windows. Each string carries a mark at either end. The
kernel counts common subsequences of three letters, up to two letters skipped between neighbours, each weighted by
DECAY to the length it spans, divided by the length norm of both strings.

Training begins with the letter sequences that are in more toxic and fewer clean texts than chance would give; the
strings of each toxic text with the strongest of them are its first witnesses. The machine learns witnesses against
strings of clean texts, each weighted by how often it was either, and variants of the witnesses with a letter added,
doubled or left out. It then names the witnesses of the toxic texts itself, and the worst strings of the clean ones,
and is trained again; ``rounds`` times. Landmarks are taken from both sides. A squared hinge loss is minimised in the
landmarks' feature space; since the kernel is an inner product over letter triples, the machine is then written as one
weight for each triple, and scoring a string takes one look-up for each of its triples.

A text's score is that of its worst string, put on the scale of probabilities by a logistic fit over the labelled
texts. ``sample_rows`` bounds the distinct labelled texts that are learned from, ``examples`` the strings and the
letter sequences.

Cases: null and empty texts and texts without letters score 0; null labels are no labels; labels of unknown documents
are ignored; a null doc_id has no label; repeated texts are learned once; without labels of both kinds, or where
nothing is told apart, all scores are 0; texts of any length are read whole in pieces of about a million characters;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import broadcast_if_small, remainder, saved, table

DECAY = 0.6
SKIP = 3  # largest step between neighbours of a subsequence
PIECE = 1_000_000
SIGNS = str.maketrans("01345@$", "oieasas")
BREAK = 0
EDGE = 60  # before and after each string; 2 to 27 are a to z, 28 to 59 the other letters
LONGEST = 40  # letters of a string; longer runs are read in windows, half of each in the next
SIZES = (4, 6, 8)  # of the letter sequences that training begins with
FEW = 20
WITNESSES = 3  # strings of a text that are learned from at most
ALPHABET = 61
STEPS = [(g, h) for g in range(1, SKIP + 1) for h in range(1, SKIP + 1)]


def code_table() -> np.ndarray:
    """Code point -> BREAK for white space, -1 for what is dropped, else a letter's number."""
    out = np.full(0x110000, -1, np.int8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = BREAK
        elif ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low - 97 + 2 if 97 <= low <= 122 else 28 + (low - 0xDF if 0xDF <= low <= 0xFE else low * 40503 // 64) % 32
    for sign, letter in SIGNS.items():
        out[sign] = ord(letter) - 97 + 2 if isinstance(letter, str) else letter - 97 + 2
    return out


class Words:
    """The words of many texts as one array of codes."""

    codes: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if Words.codes is None:
            Words.codes = code_table()
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = Words.codes[points]
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text = np.repeat(np.arange(len(texts)), lens)[: len(code)]
        kept = code >= 0
        code, text = code[kept], text[kept]
        letter = code > BREAK
        edge = np.concatenate(([True], ~letter[:-1] | (text[1:] != text[:-1]))) & letter
        start = np.flatnonzero(edge)
        word = np.cumsum(edge) - 1
        size = np.bincount(word[letter], minlength=len(start)) if len(start) else np.zeros(0, np.int64)
        of = text[start]
        single = size == 1  # i d i o t: runs of single letters become one word
        same = np.concatenate(([False], of[1:] == of[:-1])) if len(of) else single
        run = np.cumsum(~(single & np.concatenate(([False], single[:-1])) & same)) - 1 if len(of) else np.zeros(0, np.int64)
        length = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        group = np.where(length[run] >= 3, run, -1) if len(run) else run
        new = np.concatenate(([True], (group[1:] < 0) | (group[1:] != group[:-1]))) if len(group) else single
        number = np.cumsum(new) - 1
        own = number[word[letter]] if len(number) else np.zeros(0, np.int64)
        self._laid(own, code[letter], of[new])

    def _laid(self, own: np.ndarray, code: np.ndarray, text: np.ndarray) -> None:
        """Strings from letters (own: the number of each one's run); long runs in windows from 0 and from the half on."""
        n = np.bincount(own, minlength=len(text))
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        long = n[own] > LONGEST
        key = np.concatenate((own * 2, own[long] * 2 + 1))
        step = np.concatenate((np.where(long, place // LONGEST, 0), (place[long] + LONGEST // 2) // LONGEST))
        code = np.concatenate((code, code[long]))
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (step[1:] != step[:-1])))) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.append(new, len(key)))
        self.size = length + 2
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.full(int(self.size.sum()), EDGE, np.int32)
        self.letters[np.arange(len(key)) + 2 * np.repeat(np.arange(len(new)), length) + 1] = code
        self.text = text[key[new] // 2] if len(new) else np.zeros(0, np.int64)

    def strings(self) -> list[bytes]:
        whole = self.letters.astype(np.uint8).tobytes()
        return [whole[a : a + n] for a, n in zip(self.begin.tolist(), self.size.tolist(), strict=True)]


def _norms(longest: int) -> np.ndarray:
    n = np.arange(longest + 1)[:, None]
    return np.sqrt(np.maximum(sum(np.maximum(n - g - h, 0) * DECAY ** (2 * (g + h + 1)) for g, h in STEPS), 1e-9))[:, 0]


def triples(letters: np.ndarray, size: np.ndarray):
    """(word, triple, weight) arrays of the subsequences of words, for each pair of steps."""
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(letters))
    at = np.arange(len(letters))
    for g, h in sorted(STEPS, key=sum):
        at = at[left[at] > g + h]
        if not len(at):
            return
        yield word[at], (letters[at] * ALPHABET + letters[at + g]) * ALPHABET + letters[at + g + h], DECAY ** (g + h + 1)


def word_scores(letters: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(size))
    for word, triple, w in triples(letters, size):
        out += np.bincount(word, weights[triple] * w, len(size))
    return out / _norms(int(size.max(initial=0)))[size]


def _arrays(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8).astype(np.int32), np.array([len(w) for w in words], np.int64)


def features(words: list[bytes], columns: np.ndarray, n: int) -> np.ndarray:
    """Dense kernel features of words over the triples that columns numbers (-1: none)."""
    letters, size = _arrays(words)
    out = np.zeros((len(words), n))
    for word, triple, w in triples(letters, size):
        col = columns[triple]
        np.add.at(out, (word[col >= 0], col[col >= 0]), w)
    return out / _norms(int(size.max(initial=0)))[size][:, None]


class Machine:
    """One weight a triple, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def margins(self, w: Words) -> np.ndarray:
        return word_scores(w.letters, w.size, self.weights) + self.bias


def machine(words: list[bytes], bad: np.ndarray, good: np.ndarray, landmarks: list[bytes], steps: int = 15, cost: float = 2000.0) -> Machine:
    """The machine trained on words, each an insult with the weight bad and a plain word with the weight good."""
    columns = np.full(ALPHABET**3, -1, np.int32)
    used = np.unique(np.concatenate([t for _, t, _ in triples(*_arrays(landmarks))]))
    columns[used] = np.arange(len(used))
    marks = features(landmarks, columns, len(used))
    values, vectors = np.linalg.eigh(marks @ marks.T)
    kept = values > 1e-6 * values.max()
    project = marks.T @ (vectors[:, kept] / np.sqrt(values[kept]))
    z = np.concatenate([features(words[i : i + 2000], columns, len(used)) @ project for i in range(0, len(words), 2000)])
    z = np.hstack((z, np.ones((len(z), 1))))
    z, y = np.concatenate((z, z)), np.repeat([1.0, -1.0], len(words))
    c = cost * np.concatenate((bad, good))
    z, y, c = z[c > 0], y[c > 0], c[c > 0]
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):  # Newton steps on the squared hinge loss
        active = y * (z @ w) < 1
        za = z[active] * c[active][:, None]
        w = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
    weights = np.zeros(ALPHABET**3, np.float32)
    weights[used] = project @ w[:-1]
    return Machine(weights, float(w[-1]))


def parts(batches, rows: int = 500):
    """Arrow batches cut into parts of few rows, so that a task holds few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def pieces(texts: list[str], most: int = PIECE):
    """Ranges of texts of about ``most`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def worst(texts: list[str], margins, most: int = WITNESSES) -> tuple[np.ndarray, list[list[bytes]]]:
    """The margins of the ``most`` worst different strings of each text (-inf where there are fewer), and the strings."""
    margin, which = np.full((len(texts), most), -np.inf), [[] for _ in texts]
    for a, b in pieces(texts):
        w = Words(texts[a:b])
        if not len(w.size):
            continue
        f = margins(w)
        order = np.lexsort((-f, w.text))
        text = w.text[order]
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        whole = w.letters.astype(np.uint8).tobytes()
        for k, n in zip(first.tolist(), np.diff(np.append(first, len(order))).tolist(), strict=True):
            own = which[a + int(text[k])]
            for i in order[k : k + n].tolist():
                string = whole[w.begin[i] : w.begin[i] + w.size[i]]
                if string not in own:
                    margin[a + int(text[k]), len(own)] = f[i]
                    own.append(string)
                    if len(own) == most:
                        break
    return margin, which


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, clean): labelled texts with the string, from docs (text, toxic)."""

    def task(batches):
        for batch in parts(batches, 2000):
            texts, labels = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False)
            n: dict[bytes, list[int]] = {}
            for a, b in pieces(texts):
                w = Words(texts[a:b])
                for word, text in set(zip(w.strings(), w.text.tolist(), strict=True)):
                    n.setdefault(word, [0, 0])[int(labels[a + text])] += 1
            yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array([c[1] for c in n.values()], pa.int64()), pa.array([c[0] for c in n.values()], pa.int64())], names=["word", "toxic", "clean"])

    counts = docs.select("text", "toxic").mapInArrow(task, "word binary, toxic long, clean long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def sequences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, string number) of the letter sequences of :data:`SIZES` letters of all strings, marks included."""
    word = np.repeat(np.arange(len(w.size)), w.size)
    left = np.repeat(w.begin + w.size, w.size) - np.arange(len(word))
    found = []
    for size in SIZES:
        h = np.zeros(max(len(word) - size + 1, 0), np.uint64)
        for k in range(size):
            h = h * np.uint64(ALPHABET + 1) + w.letters[k : k + len(h)].astype(np.uint64)
        at = np.flatnonzero(left[: len(h)] >= size)
        found.append((h[at] * np.uint64(8) + np.uint64(size // 2), word[at]))
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def sequence_counts(docs: DataFrame) -> DataFrame:
    """(seq, toxic, clean): labelled texts with the letter sequence, from docs (text, toxic)."""

    def task(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told():
            seq, label = (np.concatenate(x) for x in zip(*held, strict=True))
            seq, at = np.unique(seq, return_inverse=True)
            toxic = np.bincount(at, label, len(seq)).astype(np.int64)
            clean = np.bincount(at, minlength=len(seq)) - toxic
            for i in range(0, len(seq), 100_000):
                cut = slice(i, i + 100_000)
                yield pa.record_batch([pa.array(seq[cut].view(np.int64)), pa.array(toxic[cut]), pa.array(clean[cut])], names=["seq", "toxic", "clean"])

        for batch in parts(batches):
            texts, labels = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pieces(texts, PIECE // 5):
                w = Words(texts[a:b])
                seq, word = sequences(w)
                text = w.text[word] if len(word) else word
                order = np.lexsort((text, seq))
                seq, text = seq[order], text[order]
                first = np.flatnonzero(np.concatenate(([True], (seq[1:] != seq[:-1]) | (text[1:] != text[:-1])))) if len(seq) else order
                held.append((seq[first], labels[a + text[first]]))
                if sum(len(h) for h, _ in held) > 1_000_000:
                    yield from told()
                    held.clear()
        if held:
            yield from told()

    counts = docs.select("text", "toxic").mapInArrow(task, "seq long, toxic long, clean long")
    return counts.groupBy("seq").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Telling:
    """Letter sequences that tell toxic texts, in ascending order, with the evidence that each one gives."""

    def __init__(self, seq: np.ndarray, evidence: np.ndarray):
        order = np.argsort(seq)
        self.seq, self.evidence = seq[order], evidence[order]

    def margins(self, w: Words) -> np.ndarray:
        """Of each string the strongest evidence among its sequences, 0 without any."""
        out = np.zeros(len(w.size))
        seq, word = sequences(w)
        if len(self.seq):
            at = np.minimum(np.searchsorted(self.seq, seq), len(self.seq) - 1)
            hit = self.seq[at] == seq
            np.maximum.at(out, word[hit], self.evidence[at[hit]])
        return out


def telling(train: DataFrame, toxic: int, clean: int, chance: float, most: int) -> Telling:
    """The ``most`` strongest sequences; chance would give fewer than ``chance`` as strong ones in all. Where labels are
    too few for that, the :data:`FEW` strongest are taken all the same."""
    counts = saved(sequence_counts(train).where("toxic > 1"))
    base = toxic / (toxic + clean)
    n, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    share = t / n
    gain = t * F.log(share / F.lit(base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0)
    need = float(np.log(max(counts.count(), 2) / chance))
    rows = counts.withColumn("gain", gain).where(share > base).orderBy(F.desc("gain"), "seq").limit(most).collect()
    rows = [r for i, r in enumerate(rows) if i < FEW or r["gain"] > need]
    return Telling(np.array([r["seq"] for r in rows], np.int64).view(np.uint64), np.array([r["gain"] for r in rows], float))


def variants(word: bytes) -> list[bytes]:
    """word with a letter doubled, added or left out."""
    out = [word[: i + 1] + word[i:] for i in range(1, len(word) - 1)]
    out += [word[:i] + bytes([2 + (7 * i + k + len(word)) % 26]) + word[i:] for i in range(2, len(word) - 1) for k in (0, 11)]
    return out + ([word[:i] + word[i + 1 :] for i in range(2, len(word) - 2)] if len(word) >= 8 else [])


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of distinct labelled texts, at most about sample_rows of them."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where("text is not null").join(broadcast_if_small(own, 2_000_000), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"))
    rows = saved(rows.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("x")).select("h", "x.*"))
    n = rows.count()
    if n > sample_rows:
        rows = saved(rows.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n)))
    return docs.join(broadcast_if_small(rows.select("doc_id", "toxic"), 2 * sample_rows), "doc_id").select("text", "toxic")


def named(train: DataFrame, margins, toxic: int, most: int, least: float, limit: int) -> dict[bytes, int]:
    """Strings with the number of texts with the label ``toxic`` that have them among their ``most`` worst, if these
    reach ``least``: of toxic texts those that most have, of clean ones the worst."""
    shared = train.sparkSession.sparkContext.broadcast(margins)

    def task(batches):
        for batch in parts(batches):
            margin, which = worst([t or "" for t in batch.column(0).to_pylist()], shared.value, most)
            own = [(s, float(m)) for found, ms in zip(which, margin, strict=True) for s, m in zip(found, ms, strict=False) if m >= least]
            yield pa.record_batch([pa.array([s for s, _ in own], pa.binary()), pa.array([m for _, m in own], pa.float64())], names=["word", "margin"])

    rows = train.where(F.col("toxic") == toxic).select("text").mapInArrow(task, "word binary, margin double").groupBy("word").agg(F.count("*").alias("n"), F.max("margin").alias("m"))
    rows = rows.orderBy(F.desc("n" if toxic else "m"), "word").limit(limit).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, examples: int = 6_000, n_landmarks: int = 400, chance: float = 0.01, rounds: int = 3):
    """(machine, slopes and offset) learned from docs (doc_id, text) and labels (doc_id, toxic), or None."""
    ship(docs.sparkSession)
    train = labelled(docs, labels, sample_rows)
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    counts = saved(word_counts(train))
    clean = counts.where(F.col("toxic") * 2 <= F.col("clean"))
    often = clean.orderBy(F.desc("clean"), "word").limit(examples // 4).collect()
    some = clean.orderBy(F.xxhash64("word"), "word").limit(examples // 2).collect()
    others = {bytes(r["word"]): r["clean"] for r in [*often, *some]}
    witnesses = named(train, telling(train, totals[1], totals[0], chance, examples).margins, 1, WITNESSES, 1e-9, examples // 4)
    if not witnesses or not others:
        return None
    hard: dict[bytes, int] = {}
    judge = None
    for k in range(rounds + 1):
        if k:
            witnesses = named(train, judge.margins, 1, WITNESSES, 0.0, examples // 4) or witnesses
            hard |= named(train, judge.margins, 0, 1, -1.0, examples // 4)
        own = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in {*witnesses, *hard}], "word binary")), "word")
        n_clean = {bytes(r["word"]): r["clean"] for r in own.collect()} | others
        words = list({**witnesses, **others, **hard})
        bad, good = np.array([witnesses.get(w, 0) for w in words], float), np.array([n_clean.get(w, 0) for w in words], float)
        more = [v for v in dict.fromkeys(v for w, x, y in zip(words, bad, good, strict=True) if x > y for v in variants(w)) if v not in n_clean][: examples // 2]
        first = sorted(witnesses, key=lambda w: (-witnesses[w], w))[: n_landmarks // 2]
        near = sorted(hard, key=lambda w: (-n_clean.get(w, 0), w))[: n_landmarks // 4]
        marks = list(dict.fromkeys([*first, *near, *list(others)[: n_landmarks - len(first) - len(near)]]))
        bad, good = bad / (WITNESSES * totals[1]), good / totals[0]  # an error counts by the share of texts that it is in
        judge = machine([*words, *more], np.append(bad, np.full(len(more), 0.5 * bad.sum() / max(len(more), 1))), np.append(good, np.zeros(len(more))), marks)
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def task(batches):
        for batch in parts(batches):
            margin, _ = worst([t or "" for t in batch.column(0).to_pylist()], shared.value.margins, 1)
            yield pa.record_batch([batch.column(1).cast(pa.int32()), pa.array(np.round(evidence(margin[:, 0]), 2))], names=["toxic", "m"])

    rows = train.select("text", "toxic").mapInArrow(task, "toxic int, m double").groupBy("toxic", "m").count().collect()  # some hundred
    m, y, n = (np.array([r[k] for r in rows], float) for k in ("m", "toxic", "count"))
    if more:  # texts with a variant count as toxic ones too, half as many as there are toxic texts
        m = np.append(m, evidence(word_scores(*_arrays(more), judge.weights) + judge.bias))
        y, n = np.append(y, np.ones(len(more))), np.append(n, np.full(len(more), totals[1] / 2 / len(more)))
    return judge, logistic(m[:, None], y, n)


def evidence(margin: np.ndarray) -> np.ndarray:
    """Margins of the worst strings of texts within bounds; the lowest one where there is no string."""
    return np.clip(np.nan_to_num(margin, neginf=-3.0), -3.0, 3.0)


def logistic(m: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Slopes and offset of a logistic regression of y on the columns of m with counts n; ridge bounds them where the
    classes part."""
    d, n = np.hstack((m, np.ones((len(m), 1)))), n / n.sum()
    loss = lambda t: float(n @ np.logaddexp(0, np.where(y > 0, -1, 1) * (d @ t)) + ridge / 2 * t @ t)
    t = np.zeros(d.shape[1])
    t[0] = 4.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(d @ t, -30, 30)))
        g = d.T @ (n * (p - y)) + ridge * t
        step = np.linalg.solve((d * (n * p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(t)), g)
        size = 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return t


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in parts(batches):
            score = np.zeros(batch.num_rows)
            if shared.value is not None:
                judge, slopes = shared.value
                margin, _ = worst([t or "" for t in batch.column(1).to_pylist()], judge.margins, 1)
                z = np.clip(evidence(margin) @ slopes[:-1] + slopes[-1], -500, 500)
                score = np.where(np.isfinite(margin[:, 0]), 1 / (1 + np.exp(-z)), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = remainder(F.col("doc_id"), 4)
    model = fit(docs.where(split != 2), table(spark, sf_dir, "labels").where(split != 2))
    return scored(docs, model).select("doc_id", F.coalesce(split == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

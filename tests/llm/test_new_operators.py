"""Spelling variants, the Merkle manifest and the Jaccard join against brute force, and their cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import jaccard, merkle, variants
from tests.llm.test_operators import LOWER, odd

WORDS = re.compile("[^\x20\x09-\x0d]+")


# --- spelling variants


def one_apart(a: str, b: str) -> bool:
    """By the full table of edit distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def brute_variants(rows: list[tuple]) -> dict:
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_apart(w, v)] for w in n}
    best = {w: min(some, key=lambda v: (-n[v], v), default=None) for w, some in near.items()}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def some_words(seed: int) -> list[tuple]:
    pick = random.Random(seed)
    base = ["letter", "lettre", "bandana", "bananas", "élèves", "aaaaa", "abababab", "straßen", "inter" * 7, "x" * 30]
    rows = []
    for i in range(400):
        words = []
        for w in pick.choices(base, weights=range(len(base), 0, -1), k=12):
            for _ in range(pick.choice([0, 0, 0, 1, 1, 2])):
                k = pick.randrange(len(w))
                w = pick.choice([w[:k] + w[k + 1 :], w[:k] + pick.choice("abÿ") + w[k + 1 :], w[:k] + pick.choice("abÿ") + w[k:]])
            words.append(pick.choice([w, w, w.upper()]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("split", [8192, 3])
def test_variants_by_brute_force(spark, split):
    """Also with segments split over many shards."""
    rows = some_words(split) + [(None, "letter, letter; letter1letter")] + [(1000, None), (1001, "")]
    want = brute_variants(rows)
    words = variants.numbered(variants.counted(spark.createDataFrame(rows, "doc_id long, text string")))
    got = {r["id"]: r["n_near"] for r in variants.near(words, shard=50, split=split).collect()}
    assert {r["word"]: got.get(r["id"], 0) for r in words.collect()} == {w: v[3] for w, v in want.items()}
    if split == 8192:
        out = variants.variants(words.select("word", "n")).collect()
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out} == want and len(out) == len(want)


def test_one_edit():
    pick = random.Random(1)
    some = ["".join(pick.choices("abÿ", k=pick.randrange(1, 9))) for _ in range(150)]
    for a in some:
        for b in some:
            assert variants.edits_are_one(a, b) == one_apart(a, b)
            if abs(len(a) - len(b)) <= 1:
                assert bool(variants.one_edit(variants.packed([a]), variants.packed([b]), len(b) - len(a))[0]) == one_apart(a, b)


def test_variants_cases(spark):
    df = odd(spark)
    out = {r["word"]: r for r in variants.variants(variants.counted(df)).collect()}
    assert out == {} or all(r["n"] >= 3 for r in out.values())
    assert variants.variants(variants.counted(df.limit(0))).count() == 0
    tie = spark.createDataFrame([(i, "abcdef abcdeg abcdeg abcdef abcdeh") for i in range(3)], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["n_near"]) for r in variants.variants(variants.counted(tie, damage=None)).collect()}
    assert got == {"abcdef": (None, 2), "abcdeg": (None, 2), "abcdeh": ("abcdef", 2)}


# --- Merkle manifest


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests: list[str], fan: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf what its runs have left and right, from below."""
    level, at, paths = digests, list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            run = level[i // fan * fan : i // fan * fan + fan]
            p.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
        at = [i // fan for i in at]
    return level[0], paths


def brute_manifest(rows: list[tuple], fan: int = 16) -> list[tuple]:
    """(doc_id, leaf, subroot, root, siblings) of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by = collections.defaultdict(list)
    for r in rows:
        by["" if r[1] is None else "+" + r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: s.encode())
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan) for s in names}
    root, tops = brute_tree([trees[s][0] for s in names], fan)
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, d, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            out.append((r[0], d, trees[s][0], root, "".join(x + y for x, y in path + top)))
    return out


def many(n: int) -> list[tuple]:
    pick = random.Random(n)
    rows = [(pick.randrange(n), pick.choice([None, "", "a", "a", "a", "é", "b", f"s{i}"]), pick.choice([None, "en"]), pick.choice([None, i]), pick.choice([None, "", "-", "Text é", f"T{i}"])) for i in range(n)]
    return rows + rows[:9] + [(None, "a", None, None, None)] * 2 + [(7, "only", "x", 1, "y")]


@pytest.mark.parametrize("fan", [16, 2])
def test_merkle_by_brute_force(spark, fan):
    """Repeated rows and ids, lone leaves, runs of one, nulls in all columns, columns with clashing names."""
    rows = many(300)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    for name in ("tree", "pos", "n", "digest", "path", "leaf", "other", "id", "file", "level"):
        df = df.withColumn(name, F.lit("clash"))
    out = merkle.manifest(merkle.leaves(df), fan)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof"), merkle.folded(F.col("leaf")).alias("again")).collect()
    want = brute_manifest(rows, fan)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r[:5]) for r in out), key=key) == sorted(((*r[:4], h(r[4])) for r in want), key=key)
    assert all(r["again"] == r["root"] for r in out)


def test_merkle_tampering_is_seen(spark):
    df = spark.createDataFrame([(i, "s", "en", 3, t) for i, t in enumerate(["ABC", "abc", None, ""])], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(merkle.leaves(df, tampered=F.lit(True)))
    got = {r["doc_id"]: r["ok"] for r in out.select("doc_id", (merkle.folded(F.col("other")) == F.col("root")).alias("ok")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}
    assert merkle.manifest(merkle.leaves(df.limit(0))).count() == 0


# --- Jaccard join


def brute_groups(rows: list[tuple]) -> dict:
    sets = {}
    for i, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed: int, n: int = 160) -> list[tuple]:
    """Families of texts that drift away from each other by few words, some just within the limit and some just without."""
    pick = random.Random(seed)
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 45, 100, 230, 600):
        base = [pick.choice("abcdefgh") + str(pick.randrange(500)) for _ in range(size)]
        for _ in range(n // 14):
            w = list(base)
            for _ in range(pick.randrange(0, 2 + size // 60)):
                k = pick.randrange(len(w))
                w[k : k + pick.choice([0, 1, 1])] = [pick.choice("XYZ") + str(pick.randrange(9))]
            if pick.random() < 0.3:
                w = w[: max(1, len(w) - pick.randrange(1, 2 + size // 6))]
            rows.append((len(rows), " ".join(w)))
            if pick.random() < 0.3:
                base = w
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [(len(rows) + k, f"{passage} " + " ".join(str(pick.random()) for _ in range(10 + k))) for k in range(30)]
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[40][1].upper())]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_by_brute_force(spark, seed, monkeypatch):
    """Also in very small tiles, so that tiles meet tiles."""
    if seed:
        monkeypatch.setattr(jaccard, "TILE", 5)
        monkeypatch.setattr(jaccard, "LOAD", 300)
        monkeypatch.setattr(jaccard, "PART", 4)
    rows = copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.grouped(df).collect()}
    assert got == brute_groups(rows)


def test_jaccard_keys_lose_no_pair():
    """Sets just within the limit share a bucket, whatever their sizes; bitmaps never differ more than the sets."""
    pick = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 200, 437, 438, 656, 657, 2000]:
        for _ in range(4):
            both = np.unique(pick.integers(0, 2**64, 3 * n, np.uint64))
            m = int(pick.integers(n, n * 5 // 4 + 1))
            common = -(-(n + m) * 4 // 9)
            pick.shuffle(both)
            a, b = np.sort(both[:n]), np.sort(np.concatenate((both[:common], both[n : n + m - common])))
            assert jaccard.links_of(np.sort(a.view(np.int64)), np.sort(b.view(np.int64)), 80, 100)
            assert set(jaccard.part_keys(a)) & set(jaccard.part_keys(b)), (n, m)
            words = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b))) // 8
            differ = int(np.bitwise_count(jaccard.folded(jaccard.bitmap(a), words) ^ jaccard.folded(jaccard.bitmap(b), words)).sum())
            assert differ <= n + m - 2 * common == jaccard.allowed(n, m)


def test_jaccard_cases(spark):
    df = odd(spark)
    out = jaccard.grouped(df).collect()
    assert len(out) == df.count()
    got = collections.defaultdict(set)
    for r in out:
        got[r["doc_id"]].add((r["n_shingles"] > 0, r["component_id"]))
    assert got[1] == {(False, 1)} and got[2] == {(False, 2)} and got[3] == {(False, 3)} and got[4] == {(True, 4)}
    assert got[6] == {(True, 5)} and got[None] == {(True, None)} and got[7] == {(True, 7)}
    assert jaccard.grouped(df.limit(0)).count() == 0

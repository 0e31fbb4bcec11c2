"""The five stages, run again in plain Python on a table with null and repeated ids, copies, foreign and leaked texts."""

from __future__ import annotations

import collections
import math
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridtide.llm import language_id, mixture
from tests.llm.test_operators import BASE, LOWER, WORD, brute_base, brute_components, brute_kneser_ney, brute_terms, odd
from tests.oracle import plain

SF = "/root/testdata/sf0.001"


def table(spark) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): 300 code points of each document, and planted rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"][:300] if r["text"] else r["text"], r["lang"], r["source"]) for r in docs]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    good = [r for r in rows if r[1] and r[2] == "en" and len(r[1]) > 200]
    rng = np.random.default_rng(8)
    junk = [" ".join("".join(rng.choice(list("qxzjkvwpg"), 7)) for _ in range(30)) for _ in range(20)]
    rows += [(None, item, "en", "src1"), (good[0][0], item, "en", "src1"), (None, good[1][1], "en", "src2"), (None, "word of " + good[2][1][:150], None, None)]
    rows += [(good[3][0], good[3][1], "en", "src3"), (good[4][0], good[5][1] + " and more", "en", "src4"), (9001, None, "en", "src1"), (9002, "", "en", "src1"), (9003, " 123 ", "en", "src1")]
    rows += [(9100 + i, t, None, "src5") for i, t in enumerate(junk)]
    rows += [(9200 + i, f"{w} Zoltan Quimby zq@here.org {good[6 + i][1][:120]}", "en", "src12") for i, w in enumerate(["ask", "tell", "see", "reach"])]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def languages(rows: list[tuple]) -> list[tuple]:
    fold = lambda r: None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 5
    learned = collections.defaultdict(list)
    for r in rows:
        if fold(r) != language_id.APART and r[1] is not None and r[2] is not None:
            learned[r[2]].append(r[1])
    models = {lang: (brute_kneser_ney(t), {}) for lang, t in sorted(learned.items())}

    def entropy(text: str, lang: str) -> float:
        p, seen = models[lang]
        s = "\0\0\0" + re.sub("\0+", "\0", "".join(c.lower() if c.isalpha() else "\0" for c in text))
        for g in {s[i - 3 : i + 1] for i in range(3, len(s))} - seen.keys():
            seen[g] = -math.log(p(g))
        return sum(seen[s[i - 3 : i + 1]] for i in range(3, len(s))) / max(len(s) - 3, 1)

    judged = []
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            judged.append((None, None))
        else:
            judged.append(min((entropy(r[1], lang), lang) for lang in models)[::-1])
    least = {}
    for lang in models:
        own = sorted(e for r, (pred, e) in zip(rows, judged, strict=True) if pred == lang == r[2] and fold(r) == language_id.APART)
        if len(own) >= 20:
            at = lambda q, own=own: own[math.ceil(q * len(own)) - 1]
            least[lang] = at(0.5) + 4 * (at(0.99) - at(0.5))
    return [r for r, (pred, e) in zip(rows, judged, strict=True) if pred and e <= least.get(pred, math.inf)]


def near_copies(rows: list[tuple]) -> list[tuple]:
    prints = []
    for r in rows:
        w = r[1].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    groups = collections.defaultdict(list)
    for r, g in zip(rows, brute_components(prints, list(range(len(rows)))), strict=True):
        groups[g].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def without_benchmark(rows: list[tuple], items: list[str]) -> list[tuple]:
    windows = set()
    for t in items:
        w = WORD.findall((t or "").translate(LOWER))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for r in rows:
        w = WORD.findall(r[1].translate(LOWER))
        hit = {k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def sanitised(rows: list[tuple]) -> list[tuple]:
    terms = brute_terms([r[1] for r in rows])
    letter = r"A-Za-z\x80-\U0010FFFF"
    out = []
    for r in rows:
        text = r[1]
        for kind, rx in BASE:
            text = rx.sub(lambda m, kind=kind: f"[{kind.upper()}]" if any(k == kind and z - a == len(m[0]) for a, _, k, z in brute_base(m[0])) else m[0], text)
        own = sorted(t for t in terms if t in set(re.findall(rf"[{letter}]+", r[1].translate(LOWER))))
        if own:
            text = re.sub(rf"(?<![{letter}])({'|'.join(own)})(?![{letter}])", "[TERM]", text, flags=re.IGNORECASE)
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def test_the_pipeline_is_that_of_brute_force(spark):
    rows = table(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = {"language_id": languages, "simhash": near_copies, "decontaminate": lambda r: without_benchmark(r, items), "pii": sanitised}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.saved(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = steps[name](rows)
        seen[name] = sorted((tuple(r) for r in docs.collect()), key=repr)
        assert [r[:2] for r in seen[name]] == [r[:2] for r in sorted(rows, key=repr)], name
    ids = {r[0] for r in seen["language_id"]}
    assert not ids & {*range(9100, 9120), 9001, 9002, 9003}
    assert sum(r[1] == items[0] for r in seen["simhash"]) <= 1 and not any(r[1] == items[0] for r in seen["decontaminate"])
    assert any("[TERM]" in r[1] and "[EMAIL]" in r[1] for r in seen["pii"])
    got = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = con.sql(mixture.SQL).fetchall()
    own = [tuple(plain(r[c]) for c in ("doc_id", "domain", "lang", "source", "n_tokens", "epoch")) for r in got.collect()]
    assert sorted(own, key=repr) == sorted(((r[0], r[1], r[2], r[3], r[6], r[5]) for r in want), key=repr)
    assert got.where(mixture.n_tokens(F.col("text")) != F.col("n_tokens")).count() == 0


@pytest.mark.parametrize("rows", [0, None])
def test_pipeline_cases(spark, rows):
    """An empty table; nulls in all columns, repeated rows and ids, long texts, columns with clashing names."""
    docs = odd(spark) if rows is None else odd(spark).limit(0)
    docs = docs.withColumn("_row", F.lit("clash")).withColumn("domain", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.saved(stage(spark, docs, SF))
        if name != "mixture":
            assert after.columns == docs.columns
        if rows is None:
            assert 0 < after.count() <= docs.count() or name == "mixture"
        docs = after
    assert rows is None or docs.count() == 0

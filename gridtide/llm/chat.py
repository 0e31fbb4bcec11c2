"""Chat formatting of reply trees: one conversation for each chosen root-to-leaf path.

Paths are enumerated by iterated self-joins: a table that leads from a message to its ancestor 2^k replies up is joined
with itself, and the (leaf, ancestor) pairs found so far are joined with it, so a path of n messages takes log2(n)
rounds and one row for each message of each path. Branches of a tree are ranked by the sum of their scores (a null score
counts as 0), ties by leaf id.

The template writes ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break for each turn.
Control strings inside roles and texts get a backslash after their first character, backslashes are doubled, line
breaks in roles are written as a backslash and n; reading back undoes all three. The loss mask is a list of (start, end) offsets in code points: the texts of the trained roles.

Cases: null texts and roles are empty; a parent that does not exist makes a root; messages on a cycle of replies, and
those that hang from one, have no root and are left out; repeated message ids of a tree count once (smallest role and
text first); a null tree id is a tree of its own; an empty table gives no conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.shipping import ship
from gridtide.llm.common import saved, table

#: Strings that chat templates give a meaning to (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = CONTROL[0], CONTROL[1]
BREAK = "\\n"  # a line break inside a role
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + "(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def plain(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)


def formatted_turns(turns: list[tuple[str, str]], trained: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escaped(role).replace(chr(10), BREAK)}\n", escaped(text)
        out += [head, body, CLOSE, "\n"]
        if role in trained:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), mask


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(plain(role, True), plain(body)) for role, body in _TURN.findall(text)]


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) of messages (tree: string, node: long, parent: long): up replies above the leaf."""
    nodes = messages.select("tree", "node")
    known = messages.join(nodes.withColumnRenamed("node", "parent"), ["tree", "parent"], "left_semi")
    jumps = [saved(known.select("tree", "node", F.col("parent").alias("above")))]
    most = messages.count().bit_length() + 1
    while not jumps[-1].isEmpty() and len(jumps) <= most:
        j = jumps[-1]
        jumps.append(saved(j.join(j.select("tree", F.col("node").alias("above"), F.col("above").alias("far")), ["tree", "above"]).select("tree", "node", F.col("far").alias("above"))))
    leaf = nodes.join(jumps[0].select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    if len(jumps) > most:  # still going up after as many steps as there are messages: a cycle
        leaf = leaf.join(jumps[-1].select("tree", "node"), ["tree", "node"], "left_anti")
    found = saved(leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k, j in enumerate(jumps):
        more = found.join(j, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = saved(found.unionByName(more))
    return found


def conversations(messages: DataFrame, best: int | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, score, n_turns, formatted, mask) of messages (tree, node, parent, role, text, score).

    ``best``: how many branches of each tree to take, by the sum of their scores, the smaller leaf on ties; None takes
    all. Branches are ranked by scores alone; only the texts of those taken are then brought together.
    """
    ship(messages.sparkSession)
    empty = {c: F.coalesce(c, F.lit("")) for c in ("role", "text")}
    rows = messages.withColumns(empty | {"score": F.coalesce(F.col("score").cast("double"), F.lit(0.0))})
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("x")).select("tree", "node", "x.*")
    found = paths(rows)
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        sums = found.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        found = found.join(saved(sums.withColumn("_rank", rank).where(F.col("_rank") <= best).select("tree", "leaf")), ["tree", "leaf"], "left_semi")
    found = found.join(rows.drop("parent"), ["tree", "node"])
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    found = found.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), turns.alias("turns"))

    def task(batches):
        for batch in batches:
            turns = batch.column(3).to_pylist()
            done = [formatted_turns([(t["role"], t["text"]) for t in x], trained) for x in turns]
            mask = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in turns], pa.int64()), pa.array([t for t, _ in done], pa.string()), mask], names=["tree", "leaf", "score", "n_turns", "formatted", "mask"])

    return found.mapInArrow(task, "tree string, leaf long, score double, n_turns long, formatted string, mask array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives: (tree, n_turns, turns_sha256, loss_chars, ...)."""
    ship(formatted.sparkSession)

    def task(batches):
        for batch in batches:
            out = []
            for tree, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                loss = "".join(plain(text[m["start"] : m["end"]]) for m in mask)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                hex_of = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((tree, len(turns), hex_of(told), len(loss), hex_of(loss), len(text)))
            names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    return formatted.select("tree", "formatted", "mask").mapInArrow(task, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


NO_TREE = "no conv_id"


def chained(rows: DataFrame) -> DataFrame:
    """Messages of rows (conv_id, turn, role, text): each turn replies to the one before."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    out = rows.withColumn("node", at).withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_TREE)))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    out = digests(conversations(chained(rows.unionByName(more)), best=1))
    return out.withColumn("conv_id", F.when(F.col("tree") != NO_TREE, F.col("tree")).cast("long")).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_LENGTHS = f"{len(OPEN) + len(CLOSE) + 2} + length(role) + length(text)"
SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, length(text) - length(replace(text, '\\', '')) AS more FROM m),
k AS (SELECT *, more + {' + '.join(f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in CONTROL)} AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_LENGTHS} + esc) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id
"""

"""Mixing sources to target weights: budgets down a tree of domain, language and source, and seeded epochs of each leaf.

A leaf can give its tokens ``max_epochs`` times; a node can give what its leaves can. The budget of the root is shared
out among its children by their weights, but no child gets more than it can give: what a child can't take goes to its
siblings by their weights, and only what all siblings together can't take is missing above them. The shares are whole
tokens: rounded down, and the rest goes one each to the largest remainders. Since a node's budget never exceeds what
its subtree can give, shortages are always made good among siblings before they reach an ancestor.

A leaf gives whole epochs while its budget lasts; of the last one, the prefix of an order seeded by the number of that
epoch and the document. The prefix is found without sorting a leaf: its documents fall into 4096 cells by the leading
digits of the hash, sums by cell give where each cell begins, and only the one cell that holds the end of the prefix is
put in order.

Only DataFrame expressions. Cases: a null text has no tokens and is never taken; null languages or sources are a leaf
named ''; nodes that have no weight of their own get ``default_weight``, weights must be whole numbers above 0; ties in
the order are broken by id, then by the number of tokens; repeated rows are taken row by row; an empty table gives an
empty result; further columns stay, but those named domain, n_tokens, epoch or taken are replaced. The pipeline's stage
cuts the text of a leaf's last document behind the last token taken, white space before it stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.llm.common import broadcast_if_small, saved, table

LEVELS = ("domain", "lang", "source")
SPACE = r"[ \t-\r]+"
MOST = 1_000_000

#: The weights of the registered query and of the pipeline (fixed values): any node may have one, by its path.
WEIGHTS = {
    ("web",): 6,
    ("books",): 3,
    ("code",): 1,
    ("web", "en"): 5,
    ("web", "de"): 2,
    ("web", "fr"): 2,
    ("web", "es"): 1,
    ("books", "en"): 2,
    ("web", "en", "src0"): 1,
    ("web", "en", "src1"): 4,
}


def domain_of(source: Column) -> Column:
    """The domain of the sources in these tables: src0 to src9 web, src10 to src16 books, the others code."""
    n = F.regexp_extract(source, r"^src([0-9]{1,6})$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n < 10, "web").when(n < 17, "books").otherwise("code")


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent, name, weight, can, budget: of the parent) with own: the budget of each child."""
    by = [F.col("can").cast("double") / F.col("weight").cast("double"), F.col(name)]
    upto = Window.partitionBy(*parent).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*by).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(38,0)")
    rows = children.withColumn("budget", F.least(F.col("budget"), F.sum("can").over(everyone)))
    rows = rows.withColumns({"full_before": F.coalesce(F.sum("can").over(upto), F.lit(0)), "weight_left": F.sum("weight").over(onward)})
    fills = big(F.col("can")) * big(F.col("weight_left")) + big(F.col("full_before")) * big(F.col("weight")) <= big(F.col("budget")) * big(F.col("weight"))
    rows = rows.withColumn("fills", fills)
    given = F.sum(F.when(F.col("fills"), F.col("can")).otherwise(0)).over(everyone)
    rows = rows.withColumns({"left": F.col("budget") - given, "all": F.sum(F.when(F.col("fills"), 0).otherwise(F.col("weight"))).over(everyone)})
    product = "cast(cast(left as decimal(38,0)) * weight as decimal(38,0))"
    rows = rows.withColumns({"part": F.expr(f"case when fills then can else cast({product} div nullif(`all`, 0) as bigint) end"), "over": F.expr(f"case when fills then 0 else cast({product} % nullif(`all`, 0) as bigint) end")})
    spare = F.col("budget") - F.sum("part").over(everyone)
    place = F.row_number().over(Window.partitionBy(*parent).orderBy("fills", F.desc("over"), name))
    rows = rows.withColumns({"spare": spare, "place": place})
    return rows.withColumn("own", F.col("part") + F.when(~F.col("fills") & (F.col("place") <= F.col("spare")), 1).otherwise(0))


def budgets(leaves: DataFrame, total: Column, weights: dict[tuple, int], default_weight: int = 1) -> DataFrame:
    """leaves (domain, lang, source, can: tokens it can give) with budget, total being a column of constants."""
    spark = leaves.sparkSession
    named = spark.createDataFrame([(".".join(k), int(w)) for k, w in weights.items()] or [("", 1)], "path string, weight long")
    nodes = leaves.groupBy(*LEVELS).agg(F.sum("can").cast("long").alias("can")).withColumn("budget", total.cast("long"))
    for depth, name in enumerate(LEVELS):
        parent, path = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        here = nodes.groupBy(*path).agg(F.sum("can").alias("can"), F.first("budget").alias("budget")).withColumn("path", F.concat_ws(".", *path))
        here = here.join(F.broadcast(named), "path", "left").withColumn("weight", F.coalesce("weight", F.lit(default_weight)).cast("long"))
        own = shared_out(here, parent or [F.lit(1)], name).select(*path, F.col("own").alias("budget"))
        nodes = nodes.drop("budget").join(own, path)
    return nodes.select(*LEVELS, "can", "budget")


def seeded(docs: DataFrame, leaf_budgets: DataFrame, seed: int, max_epochs: int) -> DataFrame:
    """docs with epoch and taken: the tokens that each epoch of a document's leaf takes from its start."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("_epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    supply = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("_supply"))
    plan = leaf_budgets.join(supply, [*LEVELS]).where("_supply > 0 and budget > 0")
    plan = plan.select(*LEVELS, F.expr("budget div _supply").alias("_epochs"), F.expr("budget % _supply").alias("_rest"))
    plan = broadcast_if_small(saved(plan), MOST)
    rows = docs.where("n_tokens > 0").join(plan, [*LEVELS])
    whole = rows.where("_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_epochs")))).withColumn("taken", F.col("n_tokens"))
    part = rows.where("_rest > 0").withColumn("_at", order).withColumn("_cell", F.substring("_at", 1, 3))
    sums = part.groupBy(*LEVELS, "_cell").agg(F.sum("n_tokens").alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.partitionBy(*LEVELS).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = saved(sums.withColumn("_begin", begin).select(*LEVELS, "_cell", "_begin", "_n"))
    part = part.join(broadcast_if_small(sums, MOST), [*LEVELS, "_cell"]).where("_begin < _rest")
    inside = part.where("_begin + _n <= _rest").withColumn("taken", F.col("n_tokens"))
    edge = Window.partitionBy(*LEVELS, "_cell").orderBy("_at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = part.where("_begin + _n > _rest").withColumn("_start", F.col("_begin") + F.coalesce(F.sum("n_tokens").over(edge), F.lit(0)))
    last = last.where("_start < _rest").withColumn("taken", F.least("n_tokens", F.col("_rest") - F.col("_start"))).drop("_start")
    more = inside.unionByName(last).drop("_at", "_cell", "_begin", "_n").withColumn("epoch", F.col("_epochs") + 1)
    return whole.unionByName(more).drop("_epochs", "_rest")


def mixed(docs: DataFrame, share: float = 0.5, weights: dict[tuple, int] | None = None, seed: int = 7, max_epochs: int = 3, domain: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) with domain, n_tokens, epoch and taken, a row for each epoch of a document.

    The budget is ``share`` of all tokens in docs. ``taken`` is n_tokens but for the last document of each leaf.
    ``domain`` gives the domain of a row, by default that of :func:`domain_of`.
    """
    named = {"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "domain": F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit(""))}
    rows = docs.withColumns(named).withColumn("n_tokens", n_tokens(F.col("text")))
    leaves = saved(rows.groupBy(*LEVELS).agg((F.sum("n_tokens") * max_epochs).alias("can"), F.sum("n_tokens").alias("n")))
    total = leaves.agg(F.floor(F.sum("n") * F.lit(share))).first()[0] or 0
    own = saved(budgets(leaves.where("can > 0"), F.lit(total), WEIGHTS if weights is None else weights))
    return seeded(rows, own, seed, max_epochs)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: the text of the last document of a leaf is cut after the tokens taken."""
    out = mixed(docs)

    words, gaps = F.split("text", SPACE), F.regexp_extract_all("text", F.lit(SPACE), F.lit(0))
    first = F.col("taken").cast("int") + (F.element_at(words, 1) == "").cast("int")  # a text may begin with white space
    size = lambda some: F.aggregate(some, F.lit(0), lambda n, x: n + F.length(x))
    end = size(F.slice(words, F.lit(1), first)) + size(F.slice(gaps, F.lit(1), first - 1))
    out = out.withColumn("text", F.when(F.col("taken") < F.col("n_tokens"), F.left("text", end)).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "lang", "source", "n_chars", "domain", "epoch", F.col("taken").alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "taken")


def _level(depth: int) -> str:
    path, parent = LEVELS[: depth + 1], LEVELS[:depth]
    cols, by = ", ".join(path), f"PARTITION BY {', '.join(parent)}" if parent else ""
    name = path[-1]
    above = f"(SELECT budget FROM share{depth - 1} p WHERE {' AND '.join(f'p.{c} = n.{c}' for c in parent)})" if parent else "(SELECT total FROM tot)"
    return f"""
n{depth} AS (SELECT {cols}, CAST(sum(can) AS HUGEINT) AS can FROM leaf GROUP BY {cols}),
a{depth} AS (SELECT n.*, CAST(coalesce(w.weight, 1) AS HUGEINT) AS weight, CAST({above} AS HUGEINT) AS up
             FROM n{depth} n LEFT JOIN w ON w.path = concat_ws('.', {', '.join('n.' + c for c in path)})),
b{depth} AS (SELECT *, least(up, sum(can) OVER ({by})) AS bud,
             coalesce(sum(can) OVER ({by} ORDER BY can::DOUBLE / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fb,
             sum(weight) OVER ({by} ORDER BY can::DOUBLE / weight::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM a{depth}),
c{depth} AS (SELECT *, can * wl + fb * weight <= bud * weight AS fills FROM b{depth}),
d{depth} AS (SELECT *, bud - coalesce(sum(can) FILTER (fills) OVER ({by}), 0) AS lft, coalesce(sum(weight) FILTER (NOT fills) OVER ({by}), 0) AS al FROM c{depth}),
e{depth} AS (SELECT *, CASE WHEN fills THEN can ELSE (lft * weight) // nullif(al, 0) END AS part, CASE WHEN fills THEN 0 ELSE (lft * weight) % nullif(al, 0) END AS ov FROM d{depth}),
share{depth} AS (SELECT {cols}, part + CASE WHEN NOT fills AND row_number() OVER ({by} {'' if by else ''} ORDER BY fills, ov DESC, {name}) <= bud - sum(part) OVER ({by}) THEN 1 ELSE 0 END AS budget FROM e{depth}),"""


SQL = f"""
WITH w(path, weight) AS (VALUES {', '.join(f"('{'.'.join(k)}', {v})" for k, v in WEIGHTS.items())}),
src AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS n_tokens,
               try_cast(nullif(regexp_extract(source, '^src([0-9]{{1,6}})$', 1), '') AS INTEGER) AS k FROM documents),
rows_ AS (SELECT doc_id, lang, source, n_tokens, CASE WHEN k < 10 THEN 'web' WHEN k < 17 THEN 'books' ELSE 'code' END AS domain FROM src),
sup AS (SELECT domain, lang, source, sum(n_tokens) AS n FROM rows_ GROUP BY ALL),
leaf AS (SELECT domain, lang, source, n * 3 AS can FROM sup WHERE n > 0),
tot AS (SELECT CAST(floor(CAST(sum(n) AS DOUBLE) * 0.5) AS BIGINT) AS total FROM sup),
{_level(0)}{_level(1)}{_level(2)}
plan AS (SELECT domain, lang, source, CAST(budget // n AS BIGINT) AS epochs, CAST(budget % n AS BIGINT) AS rest FROM share2 JOIN sup USING (domain, lang, source) WHERE budget > 0),
whole AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, epochs + 1)) AS epoch, n_tokens AS taken FROM rows_ JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
ord AS (SELECT *, md5('7:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM rows_ JOIN plan USING (domain, lang, source) WHERE n_tokens > 0 AND rest > 0),
cum AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY hx, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ord)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(taken AS BIGINT) AS taken FROM whole
UNION ALL
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT), epochs + 1, CAST(least(n_tokens, rest - start) AS BIGINT) FROM cum WHERE start < rest
"""

"""Operator 3: mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain / language / source.  A token budget enters at the root and is
passed down in proportion to the children's weights.  A child can take at most ``max_epochs``
times the tokens below it; what it cannot take goes to its siblings first, and only what all
siblings together cannot take goes back to the ancestors.  Each leaf then reads its documents in
seeded epochs (a new order each epoch) and takes the prefix of exactly its budget.

* Only ids, leaves, token counts and order keys are shuffled, never texts.
* A leaf's prefix is cut in two levels: token sums of ``CELLS`` hash ranges a leaf, then an ordered
  sum inside the one range that the budget ends in.  A leaf with a third of all rows is split
  over its ranges.
* The tree has one leaf a (domain, language, source), however many there are: languages and sources (hosts, say) stay in
  tables, and all branches of a level are shared out together.  A round fills the children that would exceed their cap and
  shares the rest anew, a sum a branch; by Newton's method on a concave function the rounds grow with the logarithm of the
  budget and the children.

Defined cases: a NULL language or source is a leaf of its own; a NULL text has no tokens and is
never taken; documents of one order key (repeated ids) are taken or left together; an
empty table gives an empty result; a leaf whose budget is zero gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonecast.llm.common import WORD, written
from zonecast.operators.ranking import grouped_row_number

CELLS = 4096
#: Leaves whose budgets are sent to every executor; more are joined by a shuffle, with the same rows.
MAX_LEAVES = 100_000
#: Of the time when leaves beyond a bound were shared; nothing reads them.
SHARED_LANGS, SHARED_SOURCES = 64, 256

#: Sources of the production mixture: the domain of source number n is DOMAINS[n // 5].
DOMAINS = ["web", "books", "code", "forum"]
#: Weights by path prefix; what is not named weighs 1 among its siblings.
WEIGHTS = {("web",): 0.4, ("books",): 0.25, ("code",): 0.2, ("forum",): 0.15,
           ("web", "en"): 2.0, ("books", "en"): 2.0, ("code", "en"): 3.0, ("forum", "en"): 2.0}


def domain_of(source: Column) -> Column:
    """``src<n>`` belongs to domain n // 5; any other source to ``other``."""
    n = F.floor(F.regexp_extract(source, r"^src(\d{1,6})$", 1).try_cast("int") / 5)
    return F.coalesce(*[F.when(n == i, F.lit(d)) for i, d in enumerate(DOMAINS)], F.lit("other"))


def shares(budget: int, weights: list[float], caps: list[int]) -> list[int]:
    """``budget`` (at most the sum of ``caps``) split in proportion to ``weights`` under ``caps``.

    Children that would exceed their cap are filled, and the rest is shared anew among the
    others; whole tokens left by rounding go to the largest remainders, ties to the lighter and then the first."""
    out, active = [0] * len(caps), [i for i, c in enumerate(caps) if c > 0 and weights[i] > 0]
    left = budget
    while active:
        total = sum(weights[i] for i in active)
        full = [i for i in active if left * weights[i] / total >= caps[i]]
        if not full:
            break
        for i in full:
            out[i] = caps[i]
        left = budget - sum(out)
        active = [i for i in active if i not in set(full)]
    if active and left > 0:
        total = sum(weights[i] for i in active)
        exact = {i: left * weights[i] / total for i in active}
        for i in active:
            out[i] = min(caps[i], int(exact[i]))
        rest = budget - sum(out)
        for i in sorted(active, key=lambda i: (-(exact[i] - int(exact[i])), weights[i], i)):
            if rest > 0 and out[i] < caps[i]:
                out[i], rest = out[i] + 1, rest - 1
    return out


def budgets(leaves: Iterable[tuple[tuple, int]], total: int, weights: dict, max_epochs: int) -> dict[tuple, int]:
    """Tokens by leaf path.  ``leaves``: (path, tokens); a weight of 0 shuts a branch out.  ``mix`` does the same in tables."""
    cap: dict[tuple, int] = {}
    children: dict[tuple, list[tuple]] = {}
    for path, tokens in leaves:
        for depth in range(len(path) + 1):
            node = path[:depth]
            if all(weights.get(path[:d], 1.0) > 0 for d in range(1, len(path) + 1)):
                cap[node] = cap.get(node, 0) + tokens * max_epochs
            if depth and node not in children.setdefault(path[:depth - 1], []):
                children[path[:depth - 1]].append(node)
    out: dict[tuple, int] = {}
    todo = [((), min(total, cap.get((), 0)))]
    while todo:
        node, budget = todo.pop()
        if node not in children:
            out[node] = budget
            continue
        below = sorted(children[node], key=lambda p: tuple((x is None, x or "") for x in p))
        todo += zip(below, shares(budget, [weights.get(p, 1.0) for p in below], [cap.get(p, 0) for p in below]))
    out.pop((), None)
    return out


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


PATH = ["domain", "lang", "source"]


def _key(columns: list[str]) -> Column:
    """A path as one text, NULL told from any text."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def _weighted(nodes: DataFrame, weights: dict, depth: int) -> DataFrame:
    """``nodes`` with ``w<depth>``, the weight of their path's first ``depth`` parts."""
    named = [(*p, float(w)) for p, w in weights.items() if len(p) == depth]
    if not named:
        return nodes.withColumn(f"w{depth}", F.lit(1.0))
    schema = ", ".join(f"{c} string" for c in PATH[:depth]) + ", w double"
    table = nodes.sparkSession.createDataFrame(named, schema).select(_key(PATH[:depth]).alias("__key"), F.col("w").alias("__w"))
    out = nodes.withColumn("__key", _key(PATH[:depth])).join(F.broadcast(table), "__key", "left")  # one row a weight
    return out.withColumn(f"w{depth}", F.coalesce("__w", F.lit(1.0))).drop("__key", "__w")


def _shared_out(children: DataFrame, budgets: DataFrame) -> DataFrame:
    """``shares`` for every branch at once.  ``children``: ``up, key, name, w, cap``, ``budgets``: ``up, budget``; returns
    ``key, budget`` of the children that can take any."""
    able = children.where("cap > 0 and w > 0")
    weight = lambda c: F.coalesce(F.sum(c.cast("decimal(28,12)")), F.lit(0)).cast("double")  # noqa: E731  (exact in any order)
    exact = F.col("left") * F.col("w") / F.nullif(F.col("total"), F.lit(0.0))
    full = F.coalesce(exact >= F.col("cap"), F.lit(True))
    state = able.groupBy("up").agg(weight(F.col("w")).alias("total")).join(budgets, "up")
    state = written(state.select("up", "budget", F.col("budget").alias("left"), "total", F.lit(0).cast("long").alias("n")), "mix-shares")
    while True:
        after = able.join(state, "up").withColumn("full", full).groupBy("up", "budget").agg(
            (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).alias("left"),
            weight(F.when(~F.col("full"), F.col("w"))).alias("total"), F.count_if("full").alias("n"), F.max("n").alias("before"))
        after = written(after, "mix-shares")
        state = after.drop("before")
        if after.where("n > before").isEmpty():
            break
    given = able.join(state, "up").select("up", "key", "name", "w", "cap", "budget", full.alias("full"), exact.alias("exact"))
    given = written(given.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.floor("exact")))), "mix-given")
    rests = given.groupBy("up", "budget").agg((F.col("budget") - F.sum("given")).alias("rest")).where("rest > 0").drop("budget")
    part = given.where("not full and given < cap").join(rests, "up").withColumn("over", F.col("exact") - F.floor("exact"))
    order = [F.col("over").desc(), F.col("w").asc(), F.col("name").asc_nulls_last(), F.col("key").asc()]
    more = grouped_row_number(part, "up", order, "place").where("place <= rest").select("key", F.lit(1).alias("one"))
    return given.join(more, "key", "left").select("key", (F.col("given") + F.coalesce("one", F.lit(0))).cast("long").alias("budget"))


def _leaf_budgets(sums: DataFrame, total: int | None, share: float, weights: dict, max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` of the leaves that are given any: ``budgets`` in tables."""
    for depth in (1, 2, 3):
        sums = _weighted(sums, weights, depth)
    cap = F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("tokens") * max_epochs).otherwise(0)
    leaves = written(sums.select(*PATH, "tokens", "w1", "w2", _key(PATH[:2]).alias("up"), _key(PATH).alias("key"), F.col("source").alias("name"),
                                 F.col("w3").alias("w"), cap.alias("cap")), "mix-tree")
    branches = written(leaves.groupBy("domain", "w1", _key(PATH[:1]).alias("up"), F.col("up").alias("key"), F.col("lang").alias("name"), F.col("w2").alias("w"))
                       .agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")), "mix-branches")
    domains = branches.groupBy("domain", "up", "w1").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).orderBy("domain").collect()  # DOMAINS and other
    if total is None:
        total = int(share * sum(r["tokens"] for r in domains))
    caps = [r["cap"] for r in domains]
    first = zip([r["up"] for r in domains], shares(min(total, sum(caps)), [r["w1"] for r in domains], caps))
    given = leaves.sparkSession.createDataFrame(list(first), "up string, budget long")
    for children in (branches, leaves):
        given = _shared_out(children, given).withColumnRenamed("key", "up")
    return leaves.drop("up").withColumnRenamed("key", "up").join(given.where("budget > 0"), "up").select(*PATH, "tokens", "budget")


def mix(docs: DataFrame, total: int | None = None, weights: dict | None = None, max_epochs: int = 2, seed: int = 7,
        share: float = 0.9) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, tokens, taken``: a row per document and epoch that a leaf's
    budget reaches.  ``taken`` is less than ``tokens`` only where a budget ends inside a document.
    ``total`` defaults to ``share`` of all tokens."""
    weights = WEIGHTS if weights is None else weights
    src = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(src).alias("domain"), F.col("lang").cast("string").alias("lang"),
                       src.alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    rows = written(rows.where(F.col("tokens") > 0), "mix-counts")
    sums = written(rows.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    path = keys = PATH
    plan = _leaf_budgets(sums, total, share, dict(weights), max_epochs)
    plan = written(plan.select(*path, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")), "mix-plan")
    n_leaves = plan.count()
    p = plan.select(*[F.col(k).alias(f"p_{k}") for k in path], "whole", "rest")
    p = F.broadcast(p) if n_leaves <= MAX_LEAVES else p
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in path]
    placed = rows.join(p, on).drop(*[f"p_{k}" for k in path])
    full = (placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
            .select("doc_id", *keys, "epoch", "tokens", F.col("tokens").alias("taken")))
    last = (placed.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("key", _order(seed, F.col("epoch"), F.col("doc_id")))
            .withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    cells = last.groupBy(*path, "rest", "cell").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*path).orderBy("cell")) - F.col("n")
    cells = cells.withColumn("before", before).where("before < rest").select(
        *[F.col(k).alias(f"p_{k}") for k in path], F.col("cell").alias("p_cell"), "before", (F.col("before") + F.col("n") <= F.col("rest")).alias("inside"))
    # at most CELLS rows a leaf
    cells = F.broadcast(cells) if n_leaves * CELLS <= 2_000_000 else cells
    reached = last.join(cells, [*on, F.col("cell") == F.col("p_cell")])
    inside = reached.where("inside").select("doc_id", *keys, "epoch", "tokens", F.col("tokens").alias("taken"))
    upto = F.sum("tokens").over(Window.partitionBy(*path, "cell").orderBy("key")) + F.col("before")
    same = Window.partitionBy(*path, "cell", "key")
    edge = (reached.where("not inside").withColumn("upto", upto).withColumn("unit", F.sum("tokens").over(same))
            .withColumn("start", F.col("upto") - F.col("unit")).where("start < rest")
            .withColumn("taken", F.when(F.col("upto") <= F.col("rest"), F.col("tokens"))
                        .otherwise(F.least("tokens", F.col("rest") - F.col("start"))))
            .select("doc_id", *keys, "epoch", "tokens", "taken"))
    return full.unionByName(inside).unionByName(edge)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``mix`` reaches, once for each epoch.  They come whole, so the last document of a
    leaf may exceed its budget.  Rows of one id in several leaves are told apart by language and source."""
    copies = mix(docs, **how).groupBy("doc_id", "lang", "source").agg(F.countDistinct("epoch").cast("int").alias("__copies"))
    copies = copies.toDF("__id", "__lang", "__source", "__copies")
    same = [F.col(c).cast(t).eqNullSafe(F.col(k)) for c, t, k in (("doc_id", "long", "__id"), ("lang", "string", "__lang"), ("source", "string", "__source"))]
    out = docs.where(F.col("text").cast("string").rlike(WORD)).join(copies, same)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)

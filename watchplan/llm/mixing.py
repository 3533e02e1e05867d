"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations alone.

A token budget goes down a tree domain -> language -> source.  At each node it is dealt among the
children by weight; a child gets no more than its subtree can give (its tokens times the allowed
epochs), and what it can't take goes to its siblings by their weights before anything is left for
the ancestors' siblings: a parent's own limit is the sum of its children's, so it is never dealt more.
A leaf then takes whole epochs and, of one more epoch in an order seeded for it, a prefix of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import broadcast_if_small, workspace, written

#: Documents of a leaf that one ordering task handles, about.
BUCKET = 2000


def n_tokens(text: Column) -> Column:
    """Words, counted as places where white space, or the beginning, is followed by another character."""
    return F.size(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "), " "), lambda w: w != "")).cast("long")


def domain_of(source: Column) -> Column:
    """Default domain of a source: by its number, three domains; sources without a number are 'other'."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.pmod(number.cast("long"), F.lit(3))).cast("string")))


def _deal(nodes: DataFrame, parents: DataFrame | None, by: list[str], level: str, budget: float | None) -> DataFrame:
    """nodes (by, level, weight, limit) with the share of their parent's budget; water-filling in closed form.

    Siblings in order of limit / weight: those before the first that isn't filled get their limit, the others
    what is left by weight.  Ordered sums over siblings, never over documents.
    """
    from pyspark.sql import Window

    nodes = nodes.join(parents, by) if by else nodes.withColumn("budget", F.lit(float(budget)))
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("limit") / F.col("weight")).otherwise(F.lit(float("inf"))))
    w = Window.partitionBy(*by).orderBy("ratio", level)
    before = F.coalesce(F.sum("limit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("rate", F.when(rest > 0, F.greatest(F.lit(0.0), F.col("budget") - before) / rest).otherwise(0.0))
    nodes = nodes.withColumn("full", F.col("ratio") <= F.col("rate"))
    common = F.min(F.when(~F.col("full"), F.struct("ratio", F.col(level).alias("l"), "rate"))).over(Window.partitionBy(*by))
    share = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.coalesce(common["rate"], F.lit(0.0))))
    return nodes.select(*by, level, share.alias("share"))


def quotas(leaves: DataFrame, budget: float, max_epochs: float, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """leaves (domain, lang, source, docs, tokens) with quota, the tokens each is to give.

    weights: {"domain": {name: weight}, "lang": {...}, "source": {...}}; names not given weigh 1.
    """
    weights = weights or {}

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for name, value in (weights.get(level) or {}).items():
            out = F.when(F.col(level) == name, F.lit(float(value))).otherwise(out)
        return out

    leaves = leaves.withColumn("limit", F.col("tokens") * F.lit(float(max_epochs)))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("limit").alias("limit")).withColumn("weight", weight("lang"))
    domains = leaves.groupBy("domain").agg(F.sum("limit").alias("limit")).withColumn("weight", weight("domain"))
    at_domain = _deal(domains, None, [], "domain", budget).withColumnRenamed("share", "budget")
    at_lang = _deal(langs, at_domain, ["domain"], "lang", None).withColumnRenamed("share", "budget")
    at_source = _deal(leaves.withColumn("weight", weight("source")), at_lang, ["domain", "lang"], "source", None)
    return leaves.drop("limit").join(at_source.select("domain", "lang", "source", F.floor(F.col("share") + 1e-6).cast("long").alias("quota")), ["domain", "lang", "source"])


def _place(key: Column, seed: int) -> Column:
    """A number in [0, 2**48) that orders the documents of a seeded epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary")), 1, 12), 16, 10).cast("long")


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _mixed(docs: DataFrame, folder: str, budget_share: float, max_epochs: float, weights: dict[str, dict[str, float]] | None, seed: int, domain: Column | None, with_sha: bool) -> DataFrame:
    """Every row of docs that has tokens, with epochs, tail_tokens and taken_tokens, which may be 0; with_sha: and its text's digest."""
    from pyspark.sql import Window

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text"), F.xxhash64(text).cast("string")))  # rows without doc_id go by their text
    rows = docs.select(doc_id.alias("doc_id"), name("lang").alias("lang"), name("source").alias("source"), n_tokens(text).alias("n_tokens"), _place(key, seed).alias("place"), *([_sha(text).alias("sha")] if with_sha else []))
    rows = rows.withColumn("domain", domain if domain is not None else domain_of(F.col("source")))
    rows = written(rows, folder, "counts").where("n_tokens > 0")
    leaf = ["domain", "lang", "source"]
    leaves = written(rows.groupBy(*leaf).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), folder, "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = quotas(leaves, budget_share * total, max_epochs, weights)
    plan = plan.select(*leaf, F.floor(F.col("quota") / F.col("tokens")).alias("epochs"), (F.col("quota") % F.col("tokens")).alias("tail"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).cast("long").alias("buckets"))
    plan = broadcast_if_small(written(plan, folder, "plan"), 120)
    bucket = F.floor(F.col("place") * F.col("buckets") / float(1 << 48)).cast("long")
    sums = rows.join(plan, leaf).groupBy(*leaf, bucket.alias("bucket")).agg(F.sum("n_tokens").alias("held"))
    # the bucket in which the leaf's prefix ends: the first that reaches beyond it
    until = F.sum("held").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("until", until).join(plan, leaf).where("until > tail").groupBy(*leaf).agg(F.min(F.struct("bucket", (F.col("until") - F.col("held")).alias("begin"))).alias("cut"))
    ends = broadcast_if_small(written(ends.select(*leaf, F.col("cut.bucket").alias("cut"), F.col("cut.begin").alias("begin")), folder, "ends"), 120)
    placed = rows.join(plan, leaf).join(ends, leaf).withColumn("bucket", bucket)
    sure = placed.where("bucket <> cut").withColumn("tail_tokens", F.when(F.col("bucket") < F.col("cut"), F.col("n_tokens")).otherwise(0))
    ties = [F.col("sha")] if with_sha else []  # rows of one doc_id with as many tokens: their texts tell them apart
    inside = Window.partitionBy(*leaf).orderBy("place", "doc_id", "n_tokens", *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    cut = placed.where("bucket = cut").withColumn("tail_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("tail") - before)))
    out = sure.unionByName(cut).withColumn("tail_tokens", F.col("tail_tokens").cast("long"))
    return out.withColumn("epochs", F.col("epochs").cast("long")).withColumn("taken_tokens", F.col("epochs") * F.col("n_tokens") + F.col("tail_tokens"))


def mix(docs: DataFrame, budget_share: float = 0.6, max_epochs: float = 3.0, weights: dict[str, dict[str, float]] | None = None, seed: int = 7, domain: Column | None = None) -> DataFrame:
    """A row per document that is taken: doc_id, domain, lang, source, n_tokens, epochs, tail_tokens, taken_tokens.

    The budget is budget_share of all tokens; a leaf's quota is rounded down to a whole token.  epochs: whole passes;
    tail_tokens: how many of the document's first tokens the last, partial epoch takes (all of them but for the
    document at the leaf's boundary).  Null lang or source is a group of its own, 'none'; null and empty texts have no
    tokens and are never taken; rows that repeat a document count each, and rows without doc_id are placed by their text.

    No task orders a leaf: documents fall into buckets by their place in the epoch, bucket sums say which one
    bucket the prefix ends in, and that alone is ordered; every other row is decided where it is.  Texts are read
    once: their counts, and the plan of the leaves, are written tables.
    """
    out = _mixed(docs, workspace(docs.sparkSession), budget_share, max_epochs, weights, seed, domain, False)
    return out.where("taken_tokens > 0").select("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "tail_tokens", "taken_tokens")


def keep_taken(docs: DataFrame, budget_share: float = 0.6, max_epochs: float = 3.0, weights: dict[str, dict[str, float]] | None = None, seed: int = 7, domain: Column | None = None) -> DataFrame:
    """docs that mix() takes at least one token of, whole and once, all columns kept.

    Rows are told apart by doc_id, lang, source and text; of rows alike in all four, all stay if one is taken.
    The keys that go, or those that stay, whichever are fewer, are broadcast if small; texts move only if not.
    """
    folder = workspace(docs.sparkSession)
    by = ["doc_id", "lang", "source", "sha"]
    rows = _mixed(docs, folder, budget_share, max_epochs, weights, seed, domain, True)
    empty = docs.sparkSession.read.parquet(f"{folder}/counts").where("n_tokens = 0").select(*by, F.lit(0).cast("long").alias("taken_tokens"))
    keys = written(rows.select(*by, "taken_tokens").unionByName(empty).groupBy(*by).agg((F.max("taken_tokens") > 0).alias("stays")), folder, "keys")
    n = keys.agg(F.count_if("stays").alias("stay"), F.count_if(~F.col("stays")).alias("go")).first()
    fewer = "left_semi" if n["stay"] < n["go"] else "left_anti"
    side = keys.where("stays" if fewer == "left_semi" else "not stays").select(*(F.col(c).alias(f"k_{c}") for c in by))
    own = {"doc_id": docs["doc_id"].cast("long"), "lang": F.coalesce(docs["lang"].cast("string"), F.lit("none")), "source": F.coalesce(docs["source"].cast("string"), F.lit("none")), "sha": _sha(docs["text"])}
    on = [own[c].eqNullSafe(F.col(f"k_{c}")) for c in by]
    return docs.join(broadcast_if_small(side, 200, min(n["stay"], n["go"])), on, fewer)

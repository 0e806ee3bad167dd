"""Duplicate coverage: exact groups, ordered leader clustering, best copy, related coverage.

Clustering contract: items are taken in ``ord`` order; an item that matches an earlier leader
follows its earliest one, any other item becomes a leader. The result does not depend on
partitioning. Items are compared with the leader's text, also after a better copy was promoted.

How it scales. Only leaders are ever compared with everything else: rows are taken in batches
of ascending ``ord``, the first one so small that all its pairs fit a budget, the batch settles its
own leaders, and all later rows are probed against these new leaders only. A large group of copies
therefore costs one probe per copy, never all pairs: its members have left the table before the
batches grow. Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.operators.pairs import SimilarityOptions, item_features, item_index, linked_items
from briefloom.operators.ranges import merge_groups
from briefloom.schemas import COVERAGE
from briefloom.session import materialize, with_scalars


#: Most rows of the first batch: most items follow an early leader and are never compared with each other.
FIRST_BATCH_ROWS = 4_000
#: Rows of a batch by those of the batch before. Large groups have met their leaders by then.
BATCH_GROWTH = 4
#: Edges that one task settles by itself.
SETTLED_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class DedupOptions:
    similarity: SimilarityOptions = field(default_factory=SimilarityOptions)
    #: pairs the rows of the first batch may make, per item and at least
    pairs_per_item: int = 1_000
    min_pair_budget: int = 400_000_000


@dataclass(frozen=True)
class DedupResult:
    """Lazy tables of one deduplication."""

    items: DataFrame  #: one row per group, the best copy, with coverage_count
    coverage: DataFrame  #: (group_ord, source_name, url, tier, ord), complete
    assignment: DataFrame  #: (ord, root): every input row and the leader of its group
    stats: DataFrame  #: one row of counters


def sort_code(*parts: tuple[Column, int]) -> Column:
    """One decimal that orders like its parts: (non-negative whole number, its largest number of digits).

    A decimal is a value that hash aggregation can keep per key, a struct is not. Null counts as 0.
    """
    if sum(digits for _, digits in parts) > 38:
        raise ValueError("a decimal has 38 digits")
    texts = [F.lpad(F.coalesce(value.cast("bigint"), F.lit(0)).cast("string"), digits, "0") for value, digits in parts]
    return F.concat(*texts).cast("decimal(38,0)")


def shorter(length: Column) -> Column:
    """Longer first, as a non-negative number."""
    return F.lit(2**31 - 1) - length


def preference(tier: str = "source_tier", ts: str = "published_at", unverified: str = "unverified", snippet: str = "snippet") -> Column:
    """Sort key of the best copy (E3): tier, dated, verified, longer snippet, then earlier."""
    flags = 2 * F.col(ts).isNull().cast("int") + F.coalesce(F.col(unverified), F.lit(False)).cast("int")
    # A missing tier comes first, as null does; tiers are small numbers.
    rank = F.when(F.col(tier).isNull(), 0).otherwise(1 + F.least(F.greatest(F.col(tier), F.lit(0)), F.lit(9_999_998)))
    return sort_code((rank, 7), (flags, 1), (shorter(F.coalesce(F.length(snippet), F.lit(0))), 10), (F.col("ord"), 19))


def code_ord(code: Column) -> Column:
    """The ``ord`` that a sort key ends with."""
    return (code % F.lit(str(10**19)).cast("decimal(20,0)")).cast("bigint")


def keep_best(df: DataFrame, key: str, rank: Column | None = None) -> DataFrame:
    """Best row per key and the number of its copies.

    ``rank`` is a ``sort_code`` that ends with the unique, non-negative ``ord``. Only keys and ranks are aggregated,
    before the shuffle, so a key that holds a large share of the rows sends one number per task;
    the winning rows are then picked by ``ord``.
    """
    rank = preference() if rank is None else rank
    best = df.groupBy(F.col(key).alias("__key")).agg(F.min(rank).alias("code"), F.count(F.lit(1)).alias("copies"))
    return df.join(best.select(code_ord(F.col("code")).alias("ord"), "copies"), "ord")


def first_by(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """First row per key in an explicit order (E8). ``order`` must be unique within the key.

    Keys and order alone are aggregated; the rows are then picked by both.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    named = [k.alias(n) for k, n in zip(keys, names)]
    first = df.groupBy(*named).agg(F.min(order).alias("__order"))
    marked = df.withColumns({**dict(zip(names, keys)), "__order": order})
    same = [marked[n].eqNullSafe(first[n]) for n in (*names, "__order")]
    return marked.join(first, reduce(lambda a, b: a & b, same), "left_semi").drop(*names, "__order")


def exact_groups(df: DataFrame, url: str = "canonical_url", digest: str = "content_hash") -> DataFrame:
    """Root of every row (D1, D2): the earliest row it reaches over equal URLs or equal fingerprints."""
    rows = df.select("ord", F.col(url).alias("canonical_url"), F.col(digest).alias("content_hash"), F.col("ord").cast("string").alias("id"))
    return merge_groups(materialize(rows, "fingerprints")).withColumnRenamed("first_ord", "root")


def _empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()


def settle_leaders(edges: DataFrame) -> DataFrame:
    """Followers among the nodes of ``edges(a, b)``, a before b, each with its earliest leader.

    Each round makes leaders of all nodes without an undecided earlier neighbour and followers
    of their later neighbours, then drops every edge of a decided node. The rounds end when the
    edges that are left fit one task, which goes through them in order.
    """
    edges = materialize(edges.select("a", "b"), "edges")
    followers = None
    undecided = edges
    while (left := undecided.count()) > 0:
        if left <= SETTLED_AT_ONCE:
            new = materialize(_settled(undecided), "followers")
            followers = new if followers is None else followers.unionByName(new)
            break
        leaders = undecided.select(F.col("a").alias("node")).distinct().join(
            undecided.select(F.col("b").alias("node")).distinct(), "node", "left_anti"
        )
        new = materialize(
            undecided.join(leaders, undecided.a == leaders.node, "left_semi").select(F.col("b").alias("node")).distinct(),
            "followers",
        )
        followers = new if followers is None else followers.unionByName(new)
        undecided = materialize(
            undecided.join(leaders, undecided.a == leaders.node, "left_anti")
            .join(new, undecided.a == new.node, "left_anti")
            .join(new, F.col("b") == new.node, "left_anti"),
            "undecided",
        )
    if followers is None:
        return edges.select(F.col("b").alias("ord"), F.col("a").alias("leader"))
    return (
        edges.join(followers, edges.a == followers.node, "left_anti")
        .groupBy(F.col("b").alias("ord"))
        .agg(F.min("a").alias("leader"))
    )


def _settled(edges: DataFrame) -> DataFrame:
    """Followers among the nodes of ``edges(a, b)``, a before b, in one task: a node that is no follower when its turn comes leads."""

    def settle(edges: pa.Table) -> pa.Table:
        a, b = (edges.column(c).to_numpy() for c in ("a", "b"))
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        order = np.argsort(places[: len(a)], kind="stable")
        a, b = places[: len(a)][order], places[len(a) :][order]
        follows = np.zeros(len(nodes), bool)
        starts = np.flatnonzero(np.diff(a, prepend=-1)).tolist()
        for start, stop in zip(starts, [*starts[1:], len(a)]):
            if not follows[a[start]]:
                follows[b[start:stop]] = True
        return pa.table({"node": nodes[follows]})

    return edges.groupBy().applyInArrow(settle, f"node {edges.schema['a'].dataType.simpleString()}")


def _batch_limit(items: DataFrame, rows: int) -> int | None:
    """Largest ``ord`` of a batch of about this many rows; None if all fit."""
    total, first = items.agg(F.count(F.lit(1)), F.min("ord")).first()
    if total <= rows:
        return None
    return max(items.agg(F.percentile_approx("ord", rows / total, 10_000)).first()[0], first)


def cluster(items: DataFrame, options: DedupOptions = DedupOptions()) -> DataFrame:
    """Leader of every item under the similarity rules: (ord, leader, fuzzy)."""
    sim = options.similarity
    features = materialize(item_features(items, sim), "features")
    index = item_index(features, sim)
    orders = features.select("ord")
    budget = max(options.min_pair_budget, options.pairs_per_item * features.count())
    rows = max(min(int((2 * budget) ** 0.5), FIRST_BATCH_ROWS), 1)
    links = None
    members, open_items = index.members, orders
    while True:
        limit = _batch_limit(open_items, rows)
        batch = members if limit is None else members.where(F.col("ord") <= limit)
        inside = materialize(settle_leaders(linked_items(index, sim, batch)), "links")
        links = inside if links is None else links.unionByName(inside)
        if limit is None:
            break
        leaders = batch.join(inside, "ord", "left_anti")
        rest = members.where(F.col("ord") > limit)
        hits = linked_items(index, sim, leaders, rest)
        probed = materialize(hits.groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("leader")), "links")
        links = links.unionByName(probed)
        members = materialize(rest.join(probed, "ord", "left_anti"), "members")
        open_items = open_items.where(F.col("ord") > limit).join(probed, "ord", "left_anti")
        rows *= BATCH_GROWTH
        if _empty(members):
            break
    return (
        orders.join(links, "ord", "left")
        .select("ord", F.coalesce("leader", "ord").alias("leader"), F.col("leader").isNotNull().alias("fuzzy"))
    )


def deduplicate(df: DataFrame, options: DedupOptions = DedupOptions(), watch: Callable[[DataFrame], DataFrame] = lambda items: items) -> DedupResult:
    """Collapse duplicate coverage (E2): exact groups first, then similar titles or snippets.

    ``watch`` may add observed counters to the items as they are written; it must not change them.

    ``df`` needs ord, id, canonical_url, content_hash, title, snippet, published_at,
    source_name, source_tier and unverified.
    """
    exact = materialize(exact_groups(df), "exact")
    roots = df.join(exact.where(F.col("ord") == F.col("root")), "ord", "left_semi")
    leaders = materialize(cluster(roots, options), "leaders")
    assignment = materialize(
        exact.join(leaders.withColumnRenamed("ord", "root"), "root").select("ord", F.col("leader").alias("root")),
        "assignment",
    )

    members = df.join(assignment, "ord").select(
        "ord", "root", "id", "canonical_url", "source_name", "source_tier", "published_at", "unverified", "snippet"
    )
    best = members.groupBy("root").agg(
        code_ord(F.min(preference())).alias("ord"),
        F.min_by("id", "ord").alias("root_id"),
        F.count(F.lit(1)).alias("group_size"),
    )
    fuzzy_roots = leaders.where("fuzzy").select(F.col("leader").alias("root")).distinct().withColumn("is_fuzzy", F.lit(True))
    best = materialize(best.join(fuzzy_roots, "root", "left"), "best")

    primary = df.join(best, "ord")
    head = primary.select("root", F.col("source_name").alias("p_source"), F.col("canonical_url").alias("p_url"), F.col("ord").alias("group_ord"))
    coverage = materialize(
        members.join(head, "root")
        .where((F.col("ord") != F.col("group_ord")) & (F.col("source_name") != F.col("p_source")))
        .groupBy("group_ord", F.col("canonical_url").alias("url"))
        .agg(F.min(F.struct("ord", "source_name", F.col("source_tier").alias("tier"))).alias("first"))
        .select("group_ord", "first.source_name", "url", "first.tier", "first.ord"),
        "coverage",
    )
    items = (
        count_coverage(primary, coverage)
        .withColumn("duplicate_group_id", F.when(F.col("is_fuzzy"), F.col("root_id")))
        .drop("root_id", "is_fuzzy")
    )
    items = materialize(watch(items), "deduplicated")  # the gate, the enrichment and the counts read it
    groups = coverage.select("group_ord").distinct().agg(F.count(F.lit(1)).alias("groups"))
    counters = best.agg(
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("items_in"),
        F.count(F.lit(1)).alias("items_out"),
        F.coalesce(F.sum(F.col("group_size") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col("ord") != F.col("root")).alias("promotions"),
    )
    stats = with_scalars(counters, groups)
    return DedupResult(items, coverage, assignment, stats)


def count_coverage(primary: DataFrame, coverage: DataFrame) -> DataFrame:
    """Number of coverage rows of every item. The rows stay in their table, whatever their number."""
    counts = coverage.groupBy(F.col("group_ord").alias("ord")).agg(F.count(F.lit(1)).alias("coverage_count"))
    joined = primary.drop("related_coverage", "coverage_count").join(counts, "ord", "left")
    return joined.withColumn("coverage_count", F.coalesce("coverage_count", F.lit(0)))


def nest_coverage(items: DataFrame, coverage: DataFrame) -> DataFrame:
    """Attach the whole coverage list to every item (E5), in item order: for readers that want one document per story."""
    lists = coverage.groupBy(F.col("group_ord").alias("ord")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("ord").alias("place"), "source_name", "url", "tier"))),
            lambda c: F.struct(c["source_name"].alias("source_name"), c["url"].alias("url"), c["tier"].alias("tier")),
        ).alias("related_coverage")
    )
    empty = F.array().cast(f"array<{COVERAGE}>")
    return items.drop("related_coverage").join(lists, "ord", "left").withColumn("related_coverage", F.coalesce("related_coverage", empty))

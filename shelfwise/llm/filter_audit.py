"""Interaction audit of document filters: decision diagrams of failure masks, one for each part, reordered by level swaps.

Which filters a document fails doesn't depend on the order that they are applied in, so a part's documents are a table of at most
2^filters failure masks with counts. A part's diagram has a level for each filter; a node stands for the documents that took the
same way to it, has their counts as its weight and leads to those that pass and those that fail the level's filter. Exchanging two
neighbouring levels rebuilds only these two, and a chain of such swaps visits every order of the filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The filters in the order of their bits: under 200 words, under half of the words distinct, over 2 % capitals, a symbol, a repeated text.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 200, 50, 2
SPACE = r"[\x20\x09-\x0D]+"
#: Groups over which rows without an id are dealt in the join with labels.
SALTS = 1024


class Diagram:
    """A reduced, ordered diagram of failure masks; equal subdiagrams are one node. Leaves and nodes weigh tuples of counts."""

    def __init__(self, cells: dict[int, tuple[int, ...]], filters: str):
        self.order = list(filters)
        self.names = filters
        self.nodes: dict[tuple, int] = {}  # (weight, passes, fails) -> id
        self.weights: list[tuple[int, ...]] = []
        self.children: list[tuple[int, int] | None] = []
        size = len(next(iter(cells.values()))) if cells else 1
        level = [self._node(cells.get(mask, (0,) * size), None) for mask in range(1 << len(filters))]
        # from the last filter to the first: a mask's lowest bit is the first filter
        for _ in filters:
            half = len(level) // 2
            level = [self._over(level[k], level[k + half]) for k in range(half)]
        self.root = level[0]

    def _node(self, weight: tuple[int, ...], children: tuple[int, int] | None) -> int:
        key = weight, children
        if key not in self.nodes:
            self.nodes[key] = len(self.weights)
            self.weights.append(weight)
            self.children.append(children)
        return self.nodes[key]

    def _over(self, passes: int, fails: int) -> int:
        return self._node(tuple(a + b for a, b in zip(self.weights[passes], self.weights[fails])), (passes, fails))

    def swap(self, at: int) -> None:
        """Exchanges the levels `at` and `at + 1`; nodes above them are rebuilt over the new ones, those below are shared."""
        made: dict[int, int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if node not in made:
                passes, fails = self.children[node]
                if depth < at:
                    made[node] = self._over(rebuilt(passes, depth + 1), rebuilt(fails, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.children[passes], self.children[fails]
                    made[node] = self._over(self._over(pp, fp), self._over(pf, ff))
            return made[node]

        self.root = rebuilt(self.root, 0)
        self.order[at], self.order[at + 1] = self.order[at + 1], self.order[at]

    def all_pass_path(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight kept, weight removed) at each level of the path on which every filter passes."""
        node, out = self.root, []
        for name in self.order:
            passes, fails = self.children[node]
            out.append((name, self.weights[passes], self.weights[fails]))
            node = passes
        return out


def adjacent_orders(n: int) -> Iterator[int | None]:
    """Swap positions that lead through all orders of n things, the first order (None) included: each element in turn moves to and fro."""
    place, at, way = list(range(n)), list(range(n)), [-1] * n
    yield None
    while True:
        moving = next((x for x in reversed(range(n)) if 0 <= at[x] + way[x] < n and place[at[x] + way[x]] < x), None)
        if moving is None:
            return
        a, b = sorted((at[moving], at[moving] + way[moving]))
        place[a], place[b] = place[b], place[a]
        at[place[a]], at[place[b]] = a, b
        for x in range(moving + 1, n):
            way[x] = -way[x]
        yield a


def audit_steps(cells: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    cells: documents, good ones and toxic ones by failure mask (bit k is filter k). `shapley` is what a filter removes over all
    orders; the other counts are those of the step.
    """
    diagram = Diagram(cells, filters)
    fails = {f: sum(n for mask, (n, *_) in cells.items() if mask >> k & 1) for k, f in enumerate(filters)}
    unique = {f: cells.get(1 << k, (0, 0, 0))[0] for k, f in enumerate(filters)}
    shapley, rows = dict.fromkeys(filters, 0), []
    for swap in adjacent_orders(len(filters)):
        if swap is not None:
            diagram.swap(swap)
        order = "".join(diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.all_pass_path(), 1):
            shapley[f] += removed[0]
            rows.append((order, step, f, kept[0], removed))
    return [(order, step, kept, n, fails[f] - n, unique[f], good, toxic, shapley[f]) for order, step, f, kept, (n, good, toxic) in rows]


def failure_bits(text: Column, words: Column) -> Column:
    """The bits of the filters that look at a text and its words alone."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = (
        F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words),
        100 * capitals > MOST_CAPITALS_PCT * F.length(text), text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def document_failures(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask: the failure mask of every document; bit 4 is set for texts that a row of a smaller doc_id has too.

    Texts are read once and leave a digest; the least doc_id of each digest is found with partial aggregates and looked up by digest
    and doc_id together, so that a text of very many rows isn't one key of a join.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    rows = rows.select("doc_id", "part", F.sha2("_text", 256).alias("digest"), failure_bits(F.col("_text"), F.col("_words")).alias("bits"))
    rows = stored(rows, "filter-failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    # rows without an id, which have no smaller one, are kept from meeting in one task
    known = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left")
    mask = F.col("bits") + F.when(F.col("is_first").isNull(), 16).otherwise(0)
    return known.select("doc_id", "part", mask.alias("mask")).unionByName(rows.where("doc_id is null").select("doc_id", "part", F.col("bits").alias("mask")))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of audit_steps: every part, all orders, every step, zeros included.

    Filters on whole texts; a document is good or toxic if any of its labels says so. Documents meet the labels as (doc_id, mask);
    a part's diagram is built from at most 32 rows in one task, whatever the part holds, and parts are spread over tasks.

    Null text: empty. Null or empty source: part ''. Null ids have no label and repeat nothing; rows of one doc_id count each and
    don't make each other repeated. An empty table gives no rows. Other columns are ignored.
    """
    failures = document_failures(documents).withColumn("_salt", F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)).alias(f"_{c}") for c in ("quality", "toxic")))
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("_quality").alias("_good"), F.max("_toxic").alias("_toxic")).withColumn("_salt", F.lit(0).cast("long"))
    marked = failures.join(marks, ["doc_id", "_salt"], "left")
    cells = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic"))

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(part["mask"], part["n"], part["good"], part["toxic"])}
        out = pd.DataFrame(audit_steps(found), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        out.insert(0, "part", part["part"].iloc[0])
        return out

    return cells.groupBy("part").applyInPandas(steps, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same rows by comparing masks with the filters before a step, without diagrams.
OP13_SQL = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
counted as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as capitals, min(doc_id) over (partition by text) as first_id from texts),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
masks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end + case when 100 * capitals > 2 * length(text) then 4 else 0 end
      + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when c.doc_id > first_id then 16 else 0 end as mask
  from counted c left join marks m on m.doc_id = c.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by part, mask),
filters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(name, bit)),
orders as (
  select concat(a.name, b.name, c.name, d.name, e.name) as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from filters a, filters b, filters c, filters d, filters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] as bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as before from orders, (select unnest(range(1, 6)) as step) s),
sums as (
  select part, filter_order, step, bit, cast(sum(case when mask & (before | bit) = 0 then n else 0 end) as bigint) as kept,
    cast(sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as bigint) as removed, cast(sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as bigint) as redundant,
    cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails, cast(sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as bigint) as good_lost,
    cast(sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as bigint) as toxic_lost
  from cells, steps group by part, filter_order, step, bit)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from sums
"""

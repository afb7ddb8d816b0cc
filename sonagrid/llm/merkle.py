"""A Merkle manifest of a table: a tree of hashes for each language, and one over their roots.

Each row is a leaf, the hash of its fields. In a tree, every ``fan`` consecutive nodes become
the hash of their hex digests, level by level, until one is left. Only every ``every`` levels
are kept, as blocks: a row of a kept level holds the ``fan ** every`` (or, at the end, fewer)
consecutive nodes below one node of the next kept level. The levels between are made anew
where they are needed:

* building climbs from a block to its node of the next kept level and keeps nothing between;
* taking proofs goes down again. From the nodes of a block its missing interior nodes are
  regenerated, the siblings of each of its nodes are emitted with those of the block's own
  node, and the interior nodes are dropped.

Rows get their places by a range sort on (language, id, leaf): the number of rows of a language
before each partition is summed over partitions, so that no window runs over the rows of one
language. Rows that are equal in all of that are dealt by where they were read, so that no
repeated row fills a task; which of them comes first makes no difference to any result.
A kept level has a row for ``fan ** every`` nodes, so what is joined on the way down is
small against the leaves, and the leaves are small against the texts, which are read once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sonagrid.llm.store import Scratch, partitions

FAN = 8
#: Levels from one kept level to the next; a block has at most FAN ** EVERY nodes.
EVERY = 3
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lowercase hex sha256 of the bytes of a string."""
    return F.sha2(value.cast("binary"), 256)


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The hash of fields: ``-`` for a null, else the number of its bytes, a colon, the value."""
    return digest(F.concat(*[_field(v) for v in values]))


def group_of(lang: Column) -> Column:
    """A key that orders as null, then the languages by their bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


@dataclass(frozen=True)
class Tree:
    """The kept levels of trees, one for each ``grp``, from the leaves up. A row is a block:
    grp, block, n (nodes of this level of the tree), nodes (array of pos, h and more)."""

    levels: list[DataFrame]
    fan: int
    every: int

    @property
    def roots(self) -> DataFrame:
        """grp, root of each tree."""
        return _named(self.levels[-1], self).select("grp", F.element_at(f"l{self.every}", 1).alias("root"))


def _placed(tables: Scratch, rows: DataFrame, order: list[str], name: str, parts: int) -> DataFrame:
    """``rows`` with pos, their place in their ``grp`` by ``order``, and n, the size of it."""
    dealt = rows.withColumn("_read", F.monotonically_increasing_id())
    by = ["grp", *order, "_read"]
    ranged = dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_read")
    # the partition and the place in it, written so that they stay whatever is lost later
    ranged = tables.table(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), f"{name}_ranged")
    runs = ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    # a row for each partition that a group has rows in
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("grp")
    runs = runs.select("grp", "part", (F.coalesce(F.sum("many").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("many").over(every).alias("n"))
    return ranged.join(runs, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes (grp, n, pos, h and more) by blocks of ``size``."""
    more = [c for c in nodes.columns if c not in ("grp", "n", "pos", "h")]
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    # at most ``size`` nodes each
    return keyed.groupBy("grp", "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "h", *more))).alias("nodes"))


def _named(blocks: DataFrame, tree: Tree) -> DataFrame:
    """Blocks with the columns l0, l1, ... of their regenerated levels, each made once."""
    blocks = blocks.withColumn("l0", F.transform("nodes", lambda x: x["h"]))
    for k in range(tree.every):
        blocks = blocks.withColumn(f"l{k + 1}", _climbed(F.col(f"l{k}"), tree))
    return blocks


def _climbed(below: Column, tree: Tree) -> Column:
    """The level above one of a block. A tree with one node left does not climb further."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / tree.fan).cast("int"))
    above = F.transform(runs, lambda k: digest(F.array_join(F.slice(below, k * tree.fan + 1, F.lit(tree.fan)), "")))
    return F.when((F.col("n") <= tree.fan**tree.every) & (F.size(below) <= 1), below).otherwise(above)


def build(tables: Scratch, rows: DataFrame, order: list[str], name: str, fan: int = FAN, every: int = EVERY, parts: int | None = None) -> Tree:
    """Trees over ``rows`` (grp, h, the columns of ``order`` and more), one for each grp."""
    size, tree = fan**every, Tree([], fan, every)
    nodes = _placed(tables, rows, order, name, parts or partitions(rows.sparkSession))
    while True:
        kept = tables.table(_blocks(nodes, size), f"{name}_{len(tree.levels)}")
        tree.levels.append(kept)
        if kept.filter("block > 0").isEmpty():
            return tree
        # a row for every block; a tree of one block has its root as the only node above
        nodes = _named(kept, tree).select("grp", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), F.element_at(f"l{every}", 1).alias("h"))


def _siblings(level: str, at: Column, fan: int) -> Column:
    """What stands before and after place ``at`` in its run of ``level``."""
    inside = at % fan
    return F.struct(
        F.array_join(F.slice(level, (at - inside + 1).cast("int"), inside.cast("int")), "").alias("l"),
        F.array_join(F.slice(level, (at + 2).cast("int"), (fan - 1 - inside).cast("int")), "").alias("r"),
    )


def proofs(tree: Tree, over: DataFrame) -> DataFrame:
    """Every leaf of ``tree``: grp, pos, h, its other columns, the columns of ``over``, and
    path: for each level the siblings before and after (l, r), from the leaf to the root.

    ``over`` has a row for each grp, with path: what comes above the root of its tree."""
    size = tree.fan**tree.every
    names = [c for c in over.columns if c not in ("grp", "path")]
    upper = over.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tree.levels):
        # regenerated, used for the nodes of this block, and dropped
        made = _named(blocks, tree).join(upper, ["grp", "block"])
        kept = [f.name for f in blocks.schema["nodes"].dataType.elementType.fields]

        def path(x: Column) -> Column:
            inside = x["pos"] % size
            steps = []
            for k in range(tree.every):
                there = (F.col("n") > size) | (F.size(f"l{k}") > 1)
                steps.append(F.when(there, F.array(_siblings(f"l{k}", F.floor(inside / tree.fan**k), tree.fan))).otherwise(F.array().cast("array<struct<l:string,r:string>>")))
            return F.concat(*steps, "path")

        out = F.transform("nodes", lambda x: F.struct(*[x[c].alias(c) for c in kept], path(x).alias("path")))
        nodes = made.select("grp", *names, F.explode(out).alias("x")).select("grp", *names, "x.*")
        upper = nodes.select("grp", *names, "path", F.col("pos").alias("block"))
    return nodes


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda node, x: digest(F.concat(x["l"], node, x["r"])))


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text has its A-Z lowered, where 3 divides the crc32 of the id
    as text; null elsewhere."""
    changed = [F.translate("text", *_LOWER) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(*changed))


def manifest(tables: Scratch, docs: DataFrame, fan: int = FAN, every: int = EVERY, checked: Column | None = None) -> tuple[Tree, Tree]:
    """(the trees of the languages, the tree over their roots) of ``docs``, kept in ``tables``.
    ``checked``: a leaf to hold against each row's own, kept beside it."""
    parts = partitions(docs.sparkSession, docs)
    other = checked if checked is not None else F.lit(None).cast("string")
    rows = docs.select(group_of(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*[F.col(c) for c in FIELDS]).alias("h"), other.alias("other"))
    trees = build(tables, rows, ["doc_id", "h"], "leaves", fan, every, parts)
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("h"))
    return trees, build(tables, tops, ["name"], "tops", fan, every)


def extract(trees: Tree, top: Tree) -> DataFrame:
    """A proof for every row: grp, doc_id, h, other, subroot, root and path."""
    none = F.array().cast("array<struct<l:string,r:string>>")
    over = proofs(top, top.roots.withColumn("path", none))
    return proofs(trees, over.select(F.col("name").alias("grp"), F.col("h").alias("subroot"), "root", "path"))


def audit(spark: SparkSession, docs: DataFrame, fan: int = FAN, every: int = EVERY) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the
    tampered leaf, or its own where the row is not tampered with) and verified.

    Nulls in any field are hashed as ``-``; a null language is a group of its own and comes
    first, null ids come first in their group and are never tampered with. Rows of one id
    are ordered by their leaf; repeated rows are leaves of their own, one after another.
    An empty table gives no rows. Columns beyond the five fields are not looked at. In a
    tampered text, bytes that are not UTF-8 are replaced, so that it is noticed."""
    docs = docs.select(*FIELDS)
    with Scratch(spark) as tables:
        found = extract(*manifest(tables, docs, fan, every, tampered(docs)))
        folded = F.when(F.col("other").isNull(), fold(F.col("h"), F.col("path"))).otherwise(fold(F.col("other"), F.col("path")))
        found = found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
        return found.withColumn("verified", F.col("folded_root") == F.col("root")).checkpoint()


def oracle(fan: int = FAN) -> str:
    """DuckDB SQL for ``audit``: levels by a recursive query, paths by the places above a
    leaf, the crc32 bit by bit."""
    low = f"translate(text, '{_LOWER[0]}', '{_LOWER[1]}')"

    def leaf_sql(text: str) -> str:
        shown = [text if c == "text" else f"cast({c} as varchar)" for c in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in shown) + ")"

    def climb(name: str) -> str:
        return f"select g, lv + 1, p // {fan}, (n + {fan - 1}) // {fan}, sha256(string_agg(h, '' order by p)) from {name} where n > 1 group by g, lv, p // {fan}, n"

    bits = "flatten(list_transform(range(1, length(d) + 1), lambda i: [ascii(d[i])::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, b: case when xor(a, b) % 2 = 1 then xor(xor(a, b) // 2, 3988292384) else xor(a, b) // 2 end), 4294967295)"
    run = f"partition by t, g, lv, p // {fan} order by p rows between"
    return f"""
with recursive
leaves as (select doc_id, coalesce('=' || lang, '-') as g, cast(doc_id as varchar) as d, {leaf_sql("text")} as leaf, {leaf_sql(low)} as low from documents),
placed as (select *, {crc} as crc, row_number() over () as i, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by g) as n from leaves),
tree(g, lv, p, n, h) as (select g, 0, p, n, leaf from placed union all {climb("tree")}),
subs as (select g, h, row_number() over (order by g) - 1 as p, count(*) over () as n from tree where n = 1),
upper(g, lv, p, n, h) as (select '', 0, p, n, h from subs union all {climb("upper")}),
nodes as (select 0 as t, * from tree union all select 1, * from upper),
steps as (select t, g, lv, p, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r from nodes where n > 1),
paths as (
  select i, t, lv, l, r from placed q join steps s on s.t = 0 and s.g = q.g and s.p = q.p // cast({fan} ** s.lv as bigint)
  union all
  select i, t, lv, l, r from placed q join subs on subs.g = q.g join steps s on s.t = 1 and s.p = subs.p // cast({fan} ** s.lv as bigint)),
proofs as (select i, string_agg(l || r, '' order by t, lv) as proof, list(l || '|' || r order by t, lv) as sides from paths group by i),
folded as (
  select doc_id, leaf, q.g, coalesce(proof, '') as proof,
         list_reduce(list_prepend(case when crc % 3 = 0 then low else leaf end, coalesce(sides, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
  from placed q left join proofs using (i))
select doc_id, leaf, subs.h as subroot, top.h as root, sha256(proof) as proof_sha256, folded_root, folded_root = top.h as verified
from folded join subs using (g) cross join (select h from upper where n = 1) top
"""

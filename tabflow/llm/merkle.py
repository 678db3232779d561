"""Merkle manifest of a table, with a proof for every row, built from concatenated levels.

A node is the SHA-256, in lowercase hex, of the concatenated hex digests of ``FAN`` consecutive
nodes below it; the last run of a level may be shorter, and even a run of one is hashed while the
level has other nodes. Nodes of a group are held in aligned blocks of ``FAN ** LEVELS``: a block
keeps each of its levels as one string of fixed-width digests, so a parent is the hash of a
``substring`` of the level below, and the siblings of a node are the substrings that flank it in
its run. The last digest of a block is a node of the tier above, which is cut into blocks in the
same way, until every group has one node, its subroot. The subroots in group order are one more
group; its last node is the root.

A block has at most 512 nodes, whatever the size of its group, so a group with most of the rows is
spread like the others. Positions come from range blocks (``ranking.row_positions``). Paths are
handed down tier by tier and joined to blocks, never to single rows. Each tier is 512 times
smaller than the one below; all are written to the shared scratch folder, so a lost executor
repeats a tier at most.

Defined cases: a null is ``-`` and an empty text ``0:`` in a leaf; null groups form a group of
their own that comes first, null ids come first in their group; rows with equal ids are ordered
by leaf, and repeated rows have equal leaves, one each; a lone row is its group's subroot, and a
lone subroot is the root; a row without any sibling has the proof of no digests, the hash of the
empty text; an empty table has no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import ascii_lower, table
from tabflow.operators.lookup import lookup_join
from tabflow.operators.ranking import row_positions
from tabflow.scratch import materialize

FAN = 8
LEVELS = 3
BLOCK = FAN ** LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Equal rows are dealt over this many keys, so that a range of them can be split.
TIES = 4096


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(*values: Column) -> Column:
    """The values one after another: UTF-8 length, a colon and the value; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _group_key(group: Column) -> Column:
    """A text that is never null and sorts like the group, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), group.cast("string")))


def _runs_hashed(level: Column, n_runs: Column) -> Column:
    """The level above ``level``: each run of ``FAN`` digests hashed."""
    run = FAN * HEX
    hashed = F.transform(F.sequence(F.lit(0), n_runs - 1), lambda r: digest(F.substring(level, r * run + 1, F.lit(run))))
    return F.array_join(hashed, "")


def _blocks(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(grp, block, n, steps, l0, l1, l2, top, items): aligned blocks of nodes (grp, pos, digest, n).

    ``n`` is the number of nodes of the group in this tier, ``steps`` how many levels the block
    climbs: all three, or fewer where the group is one block and ends in it.
    """
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", *carry)))
    rows = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), items.alias("items"))
    n = F.col("n")
    steps = F.when(n <= 1, 0).when(n <= FAN, 1).when(n <= FAN ** 2, 2).otherwise(LEVELS)
    rows = rows.select("grp", "block", "n", steps.alias("steps"), "items", F.array_join(F.transform("items", lambda x: x["digest"]), "").alias("l0"))
    # runs per level: whole numbers, rounded up
    size = [F.size("items")]
    for _ in range(LEVELS):
        size.append(F.floor((size[-1] + (FAN - 1)) / FAN).cast("int"))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"l{k}", F.when(F.col("steps") >= k, _runs_hashed(F.col(f"l{k - 1}"), size[k])))
    top = F.coalesce(*[F.col(f"l{k}") for k in range(LEVELS, -1, -1)])
    return rows.withColumn("top", top).drop(f"l{LEVELS}")


def _local_path(i: Column) -> Column:
    """The digests left and right of node ``i`` of a block, a pair for each level that the block climbs."""
    run = FAN * HEX

    def beside(k: int) -> Column:
        at = F.floor(i / FAN ** k).cast("int")
        own = F.substring(F.col(f"l{k}"), F.floor(at / FAN).cast("int") * run + 1, F.lit(run))
        within = at % FAN
        return F.struct(F.substring(own, F.lit(1), within * HEX).alias("left"), F.substring(own, within * HEX + (HEX + 1), F.lit(run)).alias("right"))

    return F.filter(F.array(*[F.when(F.col("steps") > k, beside(k)) for k in range(LEVELS)]), lambda s: s.isNotNull())


def _exploded(blocks: DataFrame, above: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Nodes of ``blocks`` with their whole paths; ``above`` (grp, block, path, ...) has what lies over each block."""
    kept = [c for c in above.columns if c not in ("grp", "block", "path")]
    joined = blocks.join(above.withColumnRenamed("path", "upper"), ["grp", "block"])
    nodes = F.transform("items", lambda x, i: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), *[x[c].alias(c) for c in carry], _local_path(i).alias("local")))
    rows = joined.select("grp", "upper", *kept, F.explode(nodes).alias("node"))
    return rows.select("grp", "node.pos", "node.digest", *[f"node.{c}" for c in carry], F.concat("node.local", "upper").alias("path"), *kept)


def _climb(nodes: DataFrame, name: str, carry: Sequence[str] = ()) -> list[DataFrame]:
    """Written blocks of every tier; the last has one block for each group."""
    tiers = [materialize(_blocks(nodes, carry), name)]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        parents = tiers[-1].select("grp", F.col("block").alias("pos"), F.col("top").alias("digest"), F.ceil(F.col("n") / BLOCK).alias("n"))
        tiers.append(materialize(_blocks(parents), name))
    return tiers


def _descend(tiers: list[DataFrame], above: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Nodes of the lowest tier with their paths; ``above`` has one row for each group."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers[1:]):
        above = _exploded(blocks, above, ()).withColumnRenamed("pos", "block").drop("digest")
    return _exploded(tiers[0], above, carry)


def prove(rows: DataFrame, *, leaf: Column, group: Column, order: Column, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(order, grp, leaf, <carry>, path, subroot, root) of every row of the manifest.

    ``path`` lists for each level from the leaf to the root the sibling digests on the ``left``
    and the ``right``, concatenated. ``grp`` is empty for the null group, else a colon and the group.
    """
    carry = dict(carry or {})
    own = rows.select(_group_key(group).alias("grp"), order.alias("order"), leaf.alias("leaf"), *[c.alias(n) for n, c in carry.items()])
    # texts are hashed once: what is sorted and placed are digests
    own = materialize(own, "merkle-leaves").withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(TIES)))
    counts = materialize(own.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("weight")), "merkle-groups")
    placed = row_positions(own, group=["grp"], order=["order", "leaf", "tie"])
    placed = lookup_join(placed, counts, ["grp"], weight="weight")
    nodes = placed.select("grp", (F.col("pos") - 1).alias("pos"), F.col("leaf").alias("digest"), "n", "order", *carry)
    tiers = _climb(nodes, "merkle-blocks", ["order", *carry])
    subroots = materialize(tiers[-1].select(F.col("grp").alias("member"), F.col("top").alias("subroot")), "merkle-subroots")
    places = row_positions(subroots.withColumn("grp", F.lit("")), group=["grp"], order=["member"])
    tops = places.select("grp", (F.col("pos") - 1).alias("pos"), F.col("subroot").alias("digest"), F.lit(subroots.count()).cast("long").alias("n"), "member")
    crown = _climb(tops, "merkle-crown", ["member"])
    root = crown[-1].select("grp", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("top").alias("root"))
    roots = _descend(crown, root, ["member"]).select(F.col("member").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    found = _descend(tiers, materialize(roots, "merkle-roots"), ["order", *carry])
    return found.select("order", "grp", F.col("digest").alias("leaf"), *carry, "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def op11(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    doc_id, text = F.col("doc_id"), F.col("text")
    tampered = F.when(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 0, ascii_lower(text)).otherwise(text)
    others = [F.col(c) for c in FIELDS if c != "text"]
    found = prove(docs, leaf=digest(encoded(*others, text)), group=F.col("lang"), order=doc_id, carry={"claimed": digest(encoded(*others, tampered))})
    folded = found.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return folded.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(x: str) -> str:
    return f"coalesce(strlen({x}) || ':' || {x}, '-')"


# the table of crc32, by its rule, as a list
_CRC_TABLE = "select list(v order by i) as t from (select i, list_reduce(range(8), lambda a, x: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as v from range(256) q(i))"

OP11_SQL = f"""
with recursive crc_table as ({_CRC_TABLE}),
d as (select row_number() over () as r, doc_id, lang, text, {' || '.join(_sql_field(x) for x in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"))} as head,
  xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), cast(4294967295 as bigint)), 4294967295) as crc
  from documents, crc_table),
m as (select *, case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other from d),
e as (select r, doc_id, lang, sha256(head || {_sql_field('text')}) as leaf, sha256(head || {_sql_field('other')}) as claimed from m),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from e),
t(lang, lvl, pos, h, n) as (
  select lang, 0, pos, leaf, n from p
  union all
  select lang, lvl + 1, pos // {FAN}, sha256(string_agg(h, '' order by pos)), min((n + {FAN - 1}) // {FAN}) from t where n > 1 group by lang, lvl, pos // {FAN}),
s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from t where n = 1),
u(lvl, pos, h, n) as (
  select 0, pos, subroot, n from s
  union all
  select lvl + 1, pos // {FAN}, sha256(string_agg(h, '' order by pos)), min((n + {FAN - 1}) // {FAN}) from u where n > 1 group by lvl, pos // {FAN}),
g as (select lang, lvl, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as lft, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as rgt
  from t where n > 1 window w as (partition by lang, lvl, pos // {FAN} order by pos)),
k as (select lvl, pos, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as lft, coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as rgt
  from u where n > 1 window w as (partition by lvl, pos // {FAN} order by pos)),
f(r, lang, lvl, pos, node, sib) as (
  select r, lang, 0, pos, claimed, '' from p
  union all
  select f.r, f.lang, f.lvl + 1, f.pos // {FAN}, sha256(g.lft || f.node || g.rgt), f.sib || g.lft || g.rgt from f join g on f.lang is not distinct from g.lang and f.lvl = g.lvl and f.pos = g.pos),
a as (select r, lang, node, sib from f qualify row_number() over (partition by r order by lvl desc) = 1),
b(r, lvl, pos, node, sib) as (
  select a.r, 0, s.pos, a.node, a.sib from a join s on a.lang is not distinct from s.lang
  union all
  select b.r, b.lvl + 1, b.pos // {FAN}, sha256(k.lft || b.node || k.rgt), b.sib || k.lft || k.rgt from b join k on b.lvl = k.lvl and b.pos = k.pos),
z as (select r, node, sib from b qualify row_number() over (partition by r order by lvl desc) = 1)
select p.doc_id, p.leaf, s.subroot, u.h as root, sha256(z.sib) as proof_sha256, z.node as folded_root, z.node = u.h as verified
from p join s on p.lang is not distinct from s.lang join z on p.r = z.r join u on u.n = 1
"""

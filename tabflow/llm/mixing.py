"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

Documents are summed by membership pattern (the set of sources a document belongs to). The
graph has one node per pattern and per source, so its size follows the number of sources and
of patterns in use, never the number of documents. It falls into connected parts: a source whose
documents belong to no other is settled in columns, every other part is one group of a grouped
job. A pattern offers its tokens once for each
permitted repetition, the r-th time at cost r: costs are convex, so every document is used
once before any is used twice. A source takes at most its quota. The flow says how many
tokens each pattern gives each source; the documents of a pattern are laid on a line in
seeded order and each source takes the ones whose middle falls into its stretch of the line.

Positions on the line are exact and need no pass over one pattern in one task: sizes are
summed by (pattern, hash slice), the slices are added up, and order within a slice is local.

Defined cases: a null text has size 0; a document without words is never taken; a null source
is a source of its own, last in order; repeated rows are taken each on its own; an empty
table gives no rows; quotas above what the documents can give are filled as far as they go;
extra columns pass through and input columns named like an output are replaced. All documents of
one connected part are routed by one task, whose work follows its patterns and sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.llm.common import WORD, bounded_broadcast, packed, table, unpacked
from tabflow.llm.components import star_labels
from tabflow.operators.lookup import lookup_join
from tabflow.operators.ranking import row_positions, running_totals
from tabflow.scratch import materialize, scope

SEED = "mix-1"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
# Hash slices of a pattern's line, and rows a slice is to hold beyond that many: one task adds up the slices of a pattern and orders the rows of a slice.
SLICES = 4_096
SLICE_ROWS = 20_000
# Documents' copy counts (some 50 bytes each) are broadcast up to this many, else joined by shuffle.
BROADCAST_TAKES = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sized: DataFrame, source: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) of every source, written once.

    Sources by code point, null last, weigh ``weights``, repeating, and divide ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess is reshared by
    weight. In order of cap over weight the capped sources come first, so running totals find
    where the capping ends; only that row comes to the driver.
    """
    totals = materialize(sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size")), "mix-totals")
    placed = row_positions(totals, order=[F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = placed.select("source", "source_size", "pos", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    placed = materialize(placed.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-caps")
    whole = placed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, all_weight = F.lit(float(share) * (whole["n"] or 0)), F.lit(float(whole["w"] or 0))
    run = running_totals(placed, order=["ratio", "pos"], sums={"caps": F.col("cap"), "weights": F.col("weight")})
    rest, rest_weight = total - F.col("caps"), all_weight - F.col("weights")
    run = materialize(run.select("source", "source_size", "pos", "weight", "cap", "ratio", rest.alias("rest"), rest_weight.alias("rest_weight")), "mix-running")
    end = run.filter("cap * rest_weight > rest * weight").orderBy("ratio", "pos").limit(1).collect()
    target = F.col("cap")
    if end:
        ratio, pos = F.lit(end[0]["ratio"]), F.lit(end[0]["pos"])
        capped = (F.col("ratio") < ratio) | ((F.col("ratio") == ratio) & (F.col("pos") < pos))
        target = F.when(capped, F.col("cap")).otherwise(F.lit(end[0]["rest"] / end[0]["rest_weight"]) * F.col("weight"))
    return materialize(run.select("source", "source_size", target.alias("target")), "mix-targets")


def route(supply: dict[tuple, int], quota: dict[object, int], max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """(pattern, source) -> tokens of a maximum flow of least repetition cost.

    Successive shortest paths with node potentials; parallel arcs carry the repetitions.
    """
    names = ["from", *supply, "to"]
    sources = {s: len(names) + i for i, s in enumerate(quota)}
    pattern = {p: i + 1 for i, p in enumerate(supply)}
    start, end = 0, len(names) - 1
    head: list[list[int]] = [[] for _ in range(len(names) + len(sources))]
    to, room, cost = [], [], []

    def arc(u: int, v: int, capacity: int, price: int) -> None:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            head[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)

    carried: dict[tuple, int] = {}
    for p, tokens in supply.items():
        for r in range(max_repeats):
            arc(start, pattern[p], tokens, r + 1)
        for s in p:
            if s in sources:
                carried[p, s] = len(to)
                arc(pattern[p], sources[s], max_repeats * tokens, 0)
    for s, tokens in quota.items():
        arc(sources[s], end, tokens, 0)
    potential = [0] * len(head)  # all costs are non-negative at first
    while True:
        distance, via = [None] * len(head), [-1] * len(head)
        distance[start], queue = 0, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            for e in head[u]:
                if room[e]:
                    v, x = to[e], d + cost[e] + potential[u] - potential[to[e]]
                    if distance[v] is None or x < distance[v]:
                        distance[v], via[v] = x, e
                        heapq.heappush(queue, (x, v))
        if distance[end] is None:
            return {key: room[e ^ 1] for key, e in carried.items() if room[e ^ 1]}
        # nodes out of reach count as at least as far as the end: reduced costs stay non-negative
        potential = [p + (distance[end] if d is None else min(d, distance[end])) for p, d in zip(potential, distance)]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def _lines(sized: DataFrame, seed: str, slices: int | None) -> DataFrame:
    """``sized`` (_row, _key, pattern, size) with ``before``: the words ahead of it on its pattern's line, written once."""
    h = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    placed = materialize(sized.withColumn("_h", h), "mix-sizes")
    slices = slices or max(SLICES, placed.count() // SLICE_ROWS)
    nth = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("int")
    placed = placed.withColumn("_slice", nth)
    by_slice = placed.groupBy("pattern", "_slice").agg(F.sum("size").alias("_n"))
    # at most ``slices`` rows a pattern
    ahead = by_slice.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("pattern").orderBy("_slice")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("pattern", "_slice").orderBy("_h", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ahead.select(F.col("pattern").alias("_p"), F.col("_slice").alias("_s"), "_ahead"), (F.col("pattern") == F.col("_p")) & (F.col("_slice") == F.col("_s")))
        .select("_row", "pattern", "size", (F.col("_ahead") + F.col("_within")).alias("before"))
    )


_STRETCH = "pattern array<string>, source string, low long, high long"


def _part_stretches(max_repeats: int):
    """The flow of one connected part of the graph, as stretches of its patterns' lines."""
    order = lambda s: (s is not None, s or "")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        named = [(tuple(None if s is None else str(s) for s in p), int(n), None if s is None else str(s), int(q)) for p, n, s, q in zip(rows["pattern"], rows["n"], rows["source"], rows["quota"])]
        supply = dict(sorted({(p, n) for p, n, _, _ in named}, key=lambda x: [order(s) for s in x[0]]))
        flow = route(supply, dict(sorted({(s, q) for _, _, s, q in named}, key=lambda x: order(x[0]))), max_repeats)
        out, at = [], {}
        for (p, s), tokens in flow.items():
            begin = at.get(p, 0)
            at[p] = begin + tokens
            for r in range(max_repeats):  # the part of the stretch in the r-th run over the line
                low, high = max(begin, r * supply[p]) - r * supply[p], min(at[p], (r + 1) * supply[p]) - r * supply[p]
                if low < high:
                    out.append((list(p), s, low, high))
        return pd.DataFrame(out, columns=["pattern", "source", "low", "high"])

    return run


def stretches(patterns: DataFrame, quota: DataFrame, max_repeats: int) -> DataFrame:
    """(pattern, source, low, high): what each source takes of the patterns' lines.

    ``patterns`` is a written table (pattern, n), ``quota`` one of (source, quota). A pattern of
    one source that no other pattern names shares nothing: its flow is a column. What is left
    falls into connected parts, and each part's flow is one group of a grouped job.
    """
    member = patterns.select("pattern", "n", F.explode("pattern").alias("source"))
    named = quota.select(F.col("source").alias("_s"), F.greatest(F.col("quota"), F.lit(0)).cast("long").alias("quota"))
    users = member.groupBy(F.col("source").alias("_u")).agg(F.count(F.lit(1)).alias("_users"))
    member = member.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").join(users, F.col("source").eqNullSafe(F.col("_u")))
    member = member.select("pattern", "n", "source", F.coalesce("quota", F.lit(0).cast("long")).alias("quota"), ((F.size("pattern") == 1) & (F.col("_users") == 1)).alias("alone"))
    member = materialize(member, "mix-members")
    runs = F.expr(f"transform(sequence(0, {max_repeats - 1}), r -> least(quota, (r + 1) * n) - r * n)")
    alone = member.filter("alone").select("pattern", "source", F.lit(0).cast("long").alias("low"), F.explode(runs).alias("high")).filter("high > 0")
    tangled = member.filter("not alone")
    if tangled.isEmpty():
        return alone
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("s"))
    tangled = tangled.withColumn("node", F.concat(F.lit("p"), F.to_json("pattern")))
    roots = star_labels(tangled.select(F.col("node").alias("a"), name.alias("b")), "mix-parts")
    parts = tangled.join(roots, "node").groupBy("root").applyInPandas(_part_stretches(max_repeats), _STRETCH)
    return alone.unionByName(parts)


def mix(docs: DataFrame, quota: Mapping[str | None, float] | DataFrame, *, members: Column, size: Column, key: str = "doc_id", max_repeats: int = MAX_REPEATS, seed: str = SEED, slices: int | None = None) -> DataFrame:
    """One row per document: its columns, ``size``, ``members`` and ``takes``, an array of (source, repeats).

    ``members`` is the array of sources a row belongs to, ``quota`` the tokens each source is
    to get, as a mapping or a table (source, quota); a source without a quota gets none.
    ``size`` is a row's tokens. A row is taken whole, at most ``max_repeats`` times over all sources.
    """
    spark = docs.sparkSession
    sets = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), sets.alias("pattern"), size.alias("size"), F.col(f"`{key}`").alias("_key"))
    lines = _lines(sized, seed, slices)
    patterns = materialize(sized.groupBy("pattern").agg(F.sum("size").alias("n")).filter("n > 0"), "mix-patterns")
    if not isinstance(quota, DataFrame):
        quota = spark.createDataFrame([(s, int(q)) for s, q in quota.items()], "source string, quota long")
    cuts = stretches(patterns, quota, max_repeats).groupBy("pattern").agg(F.collect_list(F.struct("source", "low", "high")).alias("_cuts"))
    # the text of a pattern is never null; patterns of many words are the hot keys of the join
    name = F.to_json("pattern").alias("_pattern")
    cuts = materialize(cuts.join(patterns, "pattern").select(name, "_cuts", F.col("n").alias("weight")), "mix-cuts")
    joined = lookup_join(lines.select("_row", "pattern", "size", "before", name), cuts, ["_pattern"], weight="weight")
    # a document belongs to the stretch its middle falls into; twice the middle keeps whole numbers
    inside = F.expr("filter(coalesce(_cuts, array()), c -> size > 0 and 2 * before + size > 2 * c.low and 2 * before + size <= 2 * c.high)")
    takes = F.expr("transform(array_distinct(transform(_hit, c -> struct(c.source as s))), d -> struct(d.s as source, size(filter(_hit, c -> c.source <=> d.s)) as repeats))")
    found = joined.withColumn("_hit", inside).withColumn("takes", takes)
    return found.select(*unpacked(docs.columns, ["size", "members", "takes"]), "size", F.col("pattern").alias("members"), "takes")


def single_source_mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The contract's mix: (doc_id, source, size, source_size, target, taken) of every row."""
    sized = materialize(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size")), "mix-words")
    goals = capped_targets(sized, "source", weights, share, max_repeats)
    mixed = mix(sized, _quota(goals), members=F.array("source"), size=F.col("size"), key="doc_id", max_repeats=max_repeats, seed=seed)
    named = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")).alias("_source")
    goals = goals.select(named, "source_size", "target", F.col("source_size").alias("weight"))
    found = lookup_join(mixed.select("doc_id", "source", "size", "takes", named), goals, ["_source"], weight="weight")
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def _quota(goals: DataFrame) -> DataFrame:
    return goals.select("source", F.floor("target").alias("quota"))


def _times() -> Column:
    return F.expr("aggregate(takes, 0L, (a, t) -> a + t.repeats)")


def repeated_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Each document as many times as the mix takes it, with its own columns.

    Only ids, digests and sizes are mixed; the copies are counted by (id, text digest, source)
    and joined to the documents, by broadcast while the counted rows are within
    ``BROADCAST_TAKES``. Rows that repeat all three share their copies.
    """
    digest = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{text}`").isNull())
    narrow = docs.select(F.col(f"`{key}`").alias("_id"), digest.alias("_digest"), F.col(f"`{source}`").cast("string").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"))
    with scope(docs.sparkSession):
        narrow = materialize(narrow, "mix-words")
        goals = capped_targets(narrow, "_source", weights, share, max_repeats)
        mixed = mix(narrow, _quota(goals), members=F.array("_source"), size=F.col("size"), key="_id", max_repeats=max_repeats, seed=seed)
        counted = mixed.groupBy("_id", "_digest", "_source").agg(F.sum(_times()).alias("_copies"), F.count("*").alias("_rows"))
        copies = materialize(counted.filter("_copies > 0"), "mix-copies", outlive=True)
    same = F.col(f"_row.`{key}`").eqNullSafe(F.col("_id")) & (F.col("_text_digest") == F.col("_digest")) & F.col(f"_row.`{source}`").cast("string").eqNullSafe(F.col("_source"))
    taken = packed(docs).withColumn("_text_digest", F.xxhash64(F.coalesce(F.col(f"_row.`{text}`"), F.lit("")), F.col(f"_row.`{text}`").isNull()))
    taken = taken.join(bounded_broadcast(copies, BROADCAST_TAKES), same)
    once = taken.filter("_rows = 1").select("_row", "_copies")
    if not copies.filter("_rows > 1").isEmpty():
        shared = taken.filter("_rows > 1").groupBy("_id", "_digest", "_source", "_copies").agg(F.first("_row").alias("_row"))
        once = once.unionByName(shared.select("_row", "_copies"))
    return once.select("_row", F.explode(F.expr("sequence(1L, _copies)")).alias("_i")).select("_row.*")


def op1(spark, folder: str) -> DataFrame:
    return single_source_mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, encode(source)) - 1 as k from d group by source),
w as (select *, case k % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight, 2e0 * source_size as cap from s),
o as (select *, row_number() over (order by cap / weight, k) as pos, 1.5e0 * sum(source_size) over () as total, sum(weight) over () as all_weight from w),
c as (select *, total - coalesce(sum(cap) over (order by pos rows between unbounded preceding and 1 preceding), 0) as rest, all_weight - coalesce(sum(weight) over (order by pos rows between unbounded preceding and 1 preceding), 0) as rest_weight from o),
f as (select min(pos) as pos from c where cap * rest_weight > rest * weight),
t as (select source, source_size, case when c.pos < coalesce(f.pos, 9223372036854775807) then cap else (select rest / rest_weight from c x where x.pos = f.pos) * weight end as target from c, f),
l as (select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by md5('mix-1/' || coalesce(cast(doc_id as varchar), '')), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before, cast(floor(target) as bigint) as goal
 from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(case when size = 0 then 0 else size * ((case when 2 * before + size <= 2 * least(goal, source_size) then 1 else 0 end) + (case when 2 * before + size <= 2 * greatest(goal - source_size, 0) then 1 else 0 end)) end as bigint) as taken
from l
"""

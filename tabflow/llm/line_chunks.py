"""Line dedup by content-defined chunks, in DataFrame functions only.

A text's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes marks a line
where it is divisible by ``spread``. A chunk ends at a marked line whose line before is not
marked, unless that line is the first of the text or the last but one: every chunk has two lines
or more, but that of a text of one line. Where a chunk ends depends only on the lines just around,
so an inserted or deleted line moves one or two boundaries and the rest fall into step again.
Chunks of several lines that occur more than once anywhere are removed but for their first
occurrence, by (doc_id, place).

Equal hashes only nominate: candidates are grouped by hash and by the chunk's own bytes, so
what is removed was compared byte for byte. Chunk texts move only for nominated chunks. The
nominated hashes are broadcast while their counted number is within ``BROADCAST_KEYS``, else
joined by shuffle; groups are summed map-side, so a chunk that every document carries sends
one row from each task.

Defined cases: a null text stays null and has no lines; an empty text is one empty line and a
single line is never removed; rows with the same id and the same text are one document and
keep or lose the same chunks; a null id comes first; extra columns pass through and input
columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import bounded_broadcast, packed, table
from tabflow.scratch import materialize

WINDOW = 2
SPREAD = 4
# 2^31 - 1, a prime: line hashes are below 2^28, so the products stay within a long
_PRIME = (1 << 31) - 1
BROADCAST_KEYS = 1_000_000


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunk_ends(hashes: Column, spread: int, window: int = WINDOW) -> Column:
    """Ends (exclusive) of the chunks of a text with these line hashes."""
    def rolling(i: Column) -> Column:
        h = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            h = (h * 31 + F.when(i > back, F.get(hashes, i - 1 - back)).otherwise(F.lit(0))) % F.lit(_PRIME)
        return h

    n = F.size(hashes)
    marked = F.transform(F.sequence(F.lit(1), n), lambda i: rolling(i) % F.lit(spread) == 0)
    # the marks are an array of their own, so that each is computed once
    return F.transform(F.array(marked), lambda m: F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | ((i > 1) & (i < n - 1) & F.get(m, i - 1) & ~F.get(m, i - 2))))[0]


def _chunks(docs: DataFrame, spread: int) -> DataFrame:
    """(doc_id, text_hash, start, n_lines, chunk) of every chunk of two lines or more."""
    lined = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    hashed = lined.withColumn("hashes", F.transform("lines", line_hash))
    ended = hashed.select("doc_id", "text_hash", "lines", chunk_ends(F.col("hashes"), spread).alias("ends"))
    rows = ended.select("doc_id", "text_hash", "lines", F.explode(F.arrays_zip(F.col("ends").alias("end"), F.concat(F.array(F.lit(0)), F.col("ends")).alias("start"))).alias("c"))
    rows = rows.filter(F.col("c.end") - F.col("c.start") > 1)
    return rows.select("doc_id", "text_hash", F.col("c.start").alias("start"), (F.col("c.end") - F.col("c.start")).alias("n_lines"), F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")), "\n").alias("chunk"))


def repeated_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, text_hash, start, n_lines) of every chunk occurrence to remove."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chunks = _chunks(own, spread).withColumn("h", F.xxhash64("chunk"))
    keys = materialize(chunks.select("doc_id", "text_hash", "start", "h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "chunk-keys")
    named = materialize(chunks.join(bounded_broadcast(keys, BROADCAST_KEYS), "h", "left_semi"), "chunk-candidates")
    place = F.struct("doc_id", "text_hash", "start")
    groups = named.groupBy("h", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("not first <=> last")
    # written before the join, whose sides are then plain scans: Spark can split a chunk that very many texts carry
    groups = materialize(groups, "chunk-groups")
    return named.join(groups, ["h", "chunk"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "start", "n_lines").distinct()


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and ``n_lines``, ``n_removed``."""
    gone = repeated_chunks(docs, doc_id=doc_id, text=text, spread=spread)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n_lines"))).alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"), "_gone")
    own = F.col(f"_row.`{text}`")
    joined = packed(docs).join(gone, F.col(f"_row.`{doc_id}`").eqNullSafe(F.col("_id")) & (F.xxhash64(own) == F.col("_text_hash")), "left")
    lines = F.split(own, "\n")
    # the stretches between removed chunks
    before = F.transform("_gone", lambda g, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("_gone", i - 1)["start"] + F.get("_gone", i - 1)["n_lines"]).alias("low"), g["start"].alias("high")))
    tail = F.array(F.struct((F.element_at("_gone", -1)["start"] + F.element_at("_gone", -1)["n_lines"]).alias("low"), F.size(lines).alias("high")))
    parts = F.transform(F.filter(F.concat(before, tail), lambda s: s["high"] > s["low"]), lambda s: F.array_join(F.slice(lines, s["low"] + 1, s["high"] - s["low"]), "\n"))
    new_text = F.when(F.col("_gone").isNull(), own).otherwise(F.array_join(parts, "\n"))
    n_removed = F.coalesce(F.aggregate("_gone", F.lit(0).cast("long"), lambda a, g: a + g["n_lines"]), F.lit(0).cast("long"))
    return joined.select(
        *[new_text.alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        F.when(own.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"), n_removed.alias("n_removed"),
    )


def op4(spark, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = f"""
with d as (select doc_id, text, row_number() over () as r, string_split(text, chr(10)) as ls from documents),
u as (select doc_id, text, ls, row_number() over () as k from (select distinct doc_id, text, ls from d where text is not null)),
h as (select *, [cast('0x' || substr(md5(l), 1, 7) as bigint) for l in ls] as hs from u),
mk as (select k, doc_id, ls, list_transform(generate_series(1, len(ls)), lambda i: (((case when i > 1 then hs[i-1] else 0 end) * 31 + hs[i]) % {_PRIME}) % {SPREAD} = 0) as ms from h),
b as (select k, doc_id, ls, list_filter(generate_series(1, len(ls)), lambda i: i = len(ls) or (i > 1 and i < len(ls) - 1 and ms[i] and not ms[i-1])) as ends from mk),
c as (select k, doc_id, ls, ends, unnest(generate_series(1, len(ends))) as j from b),
p as (select k, doc_id, ls, case when j = 1 then 0 else ends[j-1] end as s, ends[j] as e from c),
q as (select k, doc_id, s, e, array_to_string(ls[s+1:e], chr(10)) as chunk from p where e - s > 1),
g as (select k, s, e, row_number() over (partition by chunk order by doc_id nulls first, k, s) as nth from q),
x as (select k, list((s, e)) as spans, sum(e - s) as n_removed from (select k, s, e from g where nth > 1) group by k),
t as (select u.doc_id, u.text, n_removed, array_to_string(list_filter(ls, lambda l, i: len(list_filter(spans, lambda z: i > z[1] and i <= z[2])) = 0), chr(10)) as rest from u join x using (k))
select d.doc_id, cast(coalesce(len(d.ls), 0) as bigint) as n_lines, cast(coalesce(t.n_removed, 0) as bigint) as n_removed, sha256(coalesce(t.rest, d.text, '')) as kept_sha256
from d left join t on d.doc_id is not distinct from t.doc_id and d.text = t.text
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabflow.llm.exact_dedup import exact_duplicates, sha256_of, stream_state

ROWS = [(1, "Same TEXT", 0), (2, "same text", 0), (9, "SAME text", 0), (3, "Ünly ascii ÄÖ", 0), (4, "ünly ascii ÄÖ", 0), (5, "ÜNLY ascii ÄÖ", 0), (6, None, 0), (7, "", 0),
        (8, "repeated row", 0), (8, "repeated row", 0), (None, "without id", 0), (11, "without id", 0), (None, "alone", 0), (12, "x" * 1_000_000, 0), (13, "X" * 1_000_000, 0)]


def write(spark, path, rows=ROWS, files=4):
    spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(files).write.parquet(path)


def expected(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups: dict[str, list] = {}
    for k, t, _ in rows:
        groups.setdefault(low(t), []).append(k)
    rank = lambda k: -1 if k is None else k
    return sorted((rank(k), rank(max(groups[low(t)], key=rank)), len(groups[low(t)])) for k, t, _ in rows)


def got(df):
    rank = lambda k: -1 if k is None else k
    return sorted((rank(r["doc_id"]), rank(r["keep_id"]), r["group_size"]) for r in df.collect())


def test_equals_brute_force_in_several_batches(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path)
    found = exact_duplicates(spark, path, files_per_batch=1)
    assert got(found) == expected(ROWS)
    # one row of every group stays, also of repeated rows
    assert found.filter("kept").count() == found.select("digest").distinct().count()
    assert found.filter("kept and not doc_id <=> keep_id").count() == 0


def test_different_texts_with_one_digest_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path)
    weak = lambda normal: F.substring(sha256_of(normal), 1, 1)
    found = exact_duplicates(spark, path, digest=weak)
    assert got(found) == expected(ROWS)
    assert found.filter("kept").count() == exact_duplicates(spark, path).filter("kept").count()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    write(spark, path, ROWS[:3], 1)
    first = {r["group_size"] for r in stream_state(spark, path, checkpoint=state).collect()}
    spark.createDataFrame([(20, "same TEXT", 0)], "doc_id long, text string, digest int").coalesce(1).write.mode("append").parquet(path)
    again = stream_state(spark, path, checkpoint=state).collect()
    assert first == {3} and [(r["keep"]["doc_id"], r["group_size"]) for r in again] == [(20, 4)]


def test_single_file_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path, ROWS[:5], 1)
    one = next((tmp_path / "t.parquet").glob("part-*.parquet"))
    assert got(exact_duplicates(spark, str(one))) == expected(ROWS[:5])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e.parquet"))
    assert exact_duplicates(spark, str(tmp_path / "e.parquet")).count() == 0


def test_hits_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tabflow.llm.exact_dedup.BROADCAST_DIGESTS", 0)
    path = str(tmp_path / "t.parquet")
    write(spark, path)
    assert got(exact_duplicates(spark, path, files_per_batch=2)) == expected(ROWS)

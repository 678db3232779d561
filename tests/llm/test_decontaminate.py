from __future__ import annotations

from tabflow.llm import decontaminate
from tabflow.llm.decontaminate import build_index, cut_spans, drop_contaminated, find, scan, words_of

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "tiny item"), (3, None), (4, "..."), (2, "other words here"), (None, "alpha beta gamma")]
DOCS = [
    (1, "intro ONE two, three four\nfive six seven eight nine ten outro"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""),
    (5, "a tiny item, and alpha-beta gamma"), (5, "a tiny item, and alpha-beta gamma"), (None, "other words here " * 3), (7, "clean text about nothing"),
]


def rows(spark, **options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return [(r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], r["item_ids"]) for r in scan(docs, bench, **options).collect()]


WANT = [
    (1, 12, 10, [(1, 11)], ["1"]), (2, 9, 0, [], []), (3, 0, 0, [], []), (4, 0, 0, [], []),
    (5, 7, 5, [(1, 3), (4, 7)], ["", "2"]), (5, 7, 5, [(1, 3), (4, 7)], ["", "2"]), (None, 9, 9, [(0, 9)], ["2"]), (7, 4, 0, [], []),
]


def test_hits_spans_and_items(spark):
    assert rows(spark) == WANT


def test_blocks_of_the_benchmark_find_the_same(spark, monkeypatch):
    """Five blocks or more, read one after another; a block's index is gone before the next is built."""
    alive, most = [], []
    build, destroy = decontaminate.build_index, type(spark.sparkContext.broadcast(0)).destroy

    def built(*args):
        alive.append(1)
        most.append(len(alive))
        return build(*args)

    def destroyed(broadcast, *args):
        alive.pop()
        return destroy(broadcast, *args)

    monkeypatch.setattr(decontaminate, "build_index", built)
    monkeypatch.setattr(type(spark.sparkContext.broadcast(0)), "destroy", destroyed)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(rows(spark, block_chars=40), key=key) == sorted(WANT, key=key)
    assert len(most) >= 5 and max(most) == 1 and not alive


def test_documents_and_spans_are_removed(spark):
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in DOCS], "doc_id long, text string, spans string, n_hit int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert [(r["doc_id"], r["spans"], r["n_hit"]) for r in clean.collect()] == [(k, "n", 1) for k in (2, 3, 4, 7)]
    cut = cut_spans(docs, bench)
    assert cut.columns == docs.columns
    texts = [r["text"] for r in cut.collect()]
    assert texts == ["intro  outro", DOCS[1][1], None, "", "a , and ", "a , and ", " ", DOCS[7][1]]


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert scan(docs.filter("false"), bench).count() == 0
    assert scan(docs, bench.filter("false")).filter("n_hit > 0").count() == 0


def test_long_text_is_scanned_to_its_end():
    index = build_index([("q", "last words of a very long document are still found here")])
    hit, names = find(index, words_of("filler " * 300_000 + "last words of a very long document are still found here"))
    assert names == {"q"} and hit.sum() == 11 and hit[-11:].all()

from relspark.llm import decontaminate

from . import brute
from .data import LONG, documents, empty, odd_rows, prose


def by_hand(rows, bench):
    windows = {}
    for item, t in bench:
        w = brute.words(t)
        n = min(len(w), 13)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in rows:
        w = brute.words(t)
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= {x for x in found if x is not None}
        names = sorted(map(str, items))
        out.append((d, len(w), len(hit), len(names), brute.sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


BENCH = [
    (1, prose(30, 500)), (2, "short Item of five words"), (3, "solo"), (4, None), (5, ""), (2, prose(13, 501)), (None, prose(20, 502)),
    (10, prose(30, 500)), (6, "the the the the the the the the the the the the the the"), (7, "É été naïve 中文 " * 4),
]


def docs_rows():
    w = prose(30, 500).split()
    return odd_rows() + [
        (50, prose(100, 7) + " " + " ".join(w) + " " + prose(100, 8)), (51, " ".join(w[3:16]).upper()), (52, "x, " + ", ".join(w[:12])), (53, "a short ITEM; of five words b"),
        (54, "solo"), (55, "one solo two solo"), (56, "the " * 40), (57, LONG + " solo"), (58, prose(20, 502)), (59, "é été naïve 中文 " * 5), (60, "É été naïve 中文 " * 5),
        (61, " ".join(w) + " " + " ".join(w)), (62, prose(13, 501) + " tail"),
    ]


def test_matches_brute_force(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = docs_rows()
    got = decontaminate.contamination(documents(spark, rows), bench).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str)
    assert mine == by_hand(rows, BENCH)


def test_windows_of_13_only(spark):
    bench = spark.createDataFrame([(1, prose(40, 500))], "item_id long, text string")
    rows = docs_rows()
    got = decontaminate.contamination(documents(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == by_hand(rows, [(1, prose(40, 500))])


def test_dropping(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = docs_rows()
    docs = documents(spark, rows)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = [d for d, *_, bad in by_hand(rows, BENCH) if not bad]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    none = decontaminate.contamination(documents(spark, odd_rows()), bench.where("item_id = 99"))
    assert none.count() == len(odd_rows()) and none.where("contaminated or n_hit > 0").count() == 0

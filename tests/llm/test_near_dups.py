import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from relspark.llm import near_dups
from relspark.llm.common import stored
from relspark.llm.components import connected_components, merged_components

from . import brute
from .data import BASE, documents, edited, empty, odd_rows, prose


def truth(rows):
    """Classes by exact weighted similarity over all pairs, and by equal texts."""
    cells = []
    for _, t in rows:
        w = brute.words(t)
        seen, out = collections.Counter(), set()
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            out.add((s, seen[s]))
            seen[s] += 1
        cells.append(out)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            common = len(cells[i] & cells[j])
            if same or (common and common >= 0.8 * (len(cells[i]) + len(cells[j]) - common)):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups.values()


def test_classes_match_brute_force(spark):
    rows = odd_rows() + [(100 + i, edited(BASE, 40 + i, i)) for i in range(20)]
    rows += [(200 + i, edited(prose(250, 77), 9, i)) for i in range(6)] + [(300, "same line here now again " * 30), (301, "same line here now again " * 27)]
    got = near_dups.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_class = collections.Counter((r.class_id, ) for r in got)
    want = collections.Counter()
    for g in truth(rows):
        keys = [rows[i][0] for i in g]
        want[(min(k for k in keys if k is not None) if any(k is not None for k in keys) else None,)] += len(g)
    assert by_class == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(list(truth(rows)))


def test_large_group_of_near_copies_is_one_class_without_all_pairs(spark):
    rows = [(i, edited(BASE, 25, i)) for i in range(150)]  # two of them agree less than each with BASE
    rows.append((999, BASE))
    got = near_dups.near_duplicates(documents(spark, rows, clash=False)).collect()
    want = {frozenset(rows[i][0] for i in g) for g in truth(rows)}
    mine = collections.defaultdict(set)
    for r in got:
        mine[r.class_id].add(r.doc_id)
    assert set(map(frozenset, mine.values())) == want


def test_dropping_keeps_one_row_of_each_class(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x or 0))
    assert ids == [None, 1, 3, 4, 5, 8, 9, 11]


def test_empty_table(spark):
    assert near_dups.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("changes", [0, 1, 3, 8])
def test_signature_agreement_estimates_weighted_similarity(changes):
    texts = [prose(400, 3), " ".join(["z"] * changes * 4 + prose(400, 3).split()[changes * 12 :])]
    cells, first = near_dups.unit_cells(pa.array(texts))
    a, b = (set(cells[first[i] : first[i + 1]].tolist()) for i in (0, 1))
    k = 2000
    sig = near_dups.signatures(cells, first, k)
    assert np.isfinite(sig).all()
    real = len(a & b) / len(a | b)
    assert abs((sig[0] == sig[1]).mean() - real) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (7, 7), (9, 8), (8, 10), (10, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 10: 1, 4: 4, 5: 4}
    assert connected_components(edges.where("a > 99")).count() == 0


def test_components_after_further_links(spark):
    def links(*pairs):
        return spark.createDataFrame(list(pairs), "a long, b long")

    comp = stored(spark, connected_components(links((1, 2), (3, 4), (5, 6))), "components")
    assert merged_components(comp, links((2, 1), (6, 5))) is comp
    got = {r.node: r.component for r in merged_components(comp, links((4, 6), (7, 8), (9, 2), (8, 0))).collect()}
    assert got == {1: 1, 2: 1, 9: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 0, 8: 0, 0: 0}


def test_texts_that_share_rare_and_common_cells(spark, monkeypatch):
    """Groups whose copies share edits with one or two others, so that rare cells decide; brute force agrees."""
    monkeypatch.setattr(near_dups, "RARE", 3)
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = prose(120, 900 + g).split()
        pool = [[(r.randrange(120), f"e{g}x{i}y{j}") for j in range(r.choice((2, 4, 6)))] for i in range(12)]
        for i in range(45):
            w = list(base)
            for at, new in r.choice(pool) + r.choice(pool)[: r.randrange(4)]:
                w[at] = new
            rows.append((1000 * g + i, " ".join(w)))
    got = near_dups.near_duplicates(documents(spark, rows, clash=False)).collect()
    mine = collections.defaultdict(set)
    for x in got:
        mine[x.class_id].add(x.doc_id)
    assert set(map(frozenset, mine.values())) == {frozenset(rows[i][0] for i in g) for g in truth(rows)}


def test_hardly_a_pair_at_the_bound_meets_in_no_band():
    assert (1 - near_dups.SIMILARITY**near_dups.ROWS) ** near_dups.BANDS < 5e-5

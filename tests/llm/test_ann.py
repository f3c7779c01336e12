import numpy as np
import pytest

from relspark.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in queries:
        c = u @ u[list(ids).index(q)]
        keep = ids != q
        order = np.lexsort((ids[keep], -c[keep]))[:k]
        out[q] = [(int(ids[keep][i]), float(c[keep][i])) for i in order]
    return out


@pytest.mark.parametrize("dim,spread", [(8, 1.0), (64, 1.0), (64, 0.2)])
def test_recall(spark, dim, spread):
    r = np.random.default_rng(dim)
    centres = r.normal(size=(20, dim))
    rows = [(i, (centres[i % 20] * (1 - spread) + r.normal(size=dim) * max(spread, 0.05)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = exact(rows, range(0, 3000, 50), 5)
    got = {}
    for x in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    hit = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        hit += len({v for v, _ in best} & {m[1] for m in mine})
        for _, v, s in mine:
            assert s <= best[0][1] + 1e-9
    assert hit >= 0.9 * 5 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]),
            (8, []), (None, [1.0, 0.0]), (100, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (150, [nan, nan])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 id", "2 block", "3 part", "4 dim")
    got = sorted((x.query_id, x["rank"], x.vec_id, round(x.score, 6)) for x in ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (0, 4, 9, -1.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (50, 4, 9, 0.0)]
    assert ann.nearest(df.where("vec_id = 77"), df).count() == 0


def test_chi2_quantile():
    # tabled values
    for p, d, v in ((0.95, 8, 15.507), (0.99, 8, 20.090), (0.5, 1, 0.455), (0.99, 2, 9.210)):
        assert abs(ann.chi2_quantile(p, d) - v) < 1e-3


def test_tree_leaves_hold_every_point_inside_their_box():
    x = np.random.default_rng(1).normal(size=(1000, 3))
    x[100:300] = x[0]
    order, first, low, high = ann.build_tree(x, 16)
    assert sorted(order) == list(range(1000)) and np.diff(first).max() <= 16
    for i in range(len(low)):
        part = x[order[first[i] : first[i + 1]]]
        assert (part >= low[i]).all() and (part <= high[i]).all()


def by_query(rows):
    out = {}
    for x in rows:
        out.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    return {q: [v for _, v, _ in sorted(m)] for q, m in out.items()}


def test_equal_vectors_rank_by_id(spark):
    """Products of equal vectors differ in the last bit with their place; the ranks must not."""
    r = np.random.default_rng(4)
    for trial in range(3):
        base, turned = r.normal(size=64), r.normal(size=64)
        rows = [(i, base.tolist()) for i in range(200)] + [(i, (2.0 * base).tolist()) for i in range(200, 230)]
        rows += [(i, (turned + 0.01 * r.normal(size=64)).tolist()) for i in range(230, 400)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = by_query(ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
        assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[150] == [0, 1, 2, 3, 4]


def test_many_cells_and_parts(spark, monkeypatch):
    """A tree of many cells, cells of several blocks, several parts of queries: recall and no lost query."""
    for name, value in (("CELL_ROWS", 64), ("SAMPLE", 512), ("BLOCK_ROWS", 100), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 32))
    rows = [(i, (centres[i % 30] + 0.3 * r.normal(size=32)).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = by_query(ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    want = exact(rows, range(0, 2500, 50), 5)
    assert set(got) == set(want) and all(len(g) == 5 for g in got.values())
    assert sum(len({v for v, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def test_cells_route_every_point(spark):
    x = np.random.default_rng(1).normal(size=(3000, 4))
    x[:1500, 0] = 0.5
    x[:700] = x[0]
    cells = ann.Cells.of(x[::3], 40)
    at = cells.route(x)
    assert len(set(at[:700])) == 1 and len(np.unique(at)) >= 20 and np.bincount(at)[np.setdiff1d(np.unique(at), at[0])].max() < 600


def test_a_vector_on_a_third_of_all_rows_is_no_hot_cell(spark):
    r = np.random.default_rng(2)
    same = r.normal(size=16).tolist()
    rows = [(i, same if i % 3 == 0 else r.normal(size=16).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = by_query(ann.nearest(df, df.where("vec_id % 50 = 0")).collect())
    assert got[0] == [3, 6, 9, 12, 15] and got[300] == [0, 3, 6, 9, 12]

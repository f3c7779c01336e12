import collections
import zlib

from pyspark.sql import functions as F

from relspark.llm import sharding

from .data import documents, empty, odd_rows, prose


def rows_with_groups():
    rows = [(i, prose(5, i)) for i in range(700)]
    rows += [(1000 + i, f"hot {prose(4, 1)}") for i in range(380)]  # a third of all, far over a shard's quota
    for g in range(12):
        rows += [(2000 + 50 * g + i, f"group {g}") for i in range(5 + g)]
    return rows


def test_sizes_slots_and_columns(spark):
    rows = rows_with_groups() + odd_rows()
    got = sharding.shard_documents(documents(spark, rows), shards=40).collect()
    assert len(got) == len(rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(40)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_linked_documents_come_together(spark):
    rows = rows_with_groups()
    docs = documents(spark, rows, clash=False)
    one = documents(spark, rows, clash=False).select(
        F.monotonically_increasing_id().alias("row_id"), F.xxhash64("doc_id").alias("order"), F.col("text").alias("link"))
    from relspark.llm.common import stored

    one = stored(spark, one, "vertices")
    before = sharding.cut_links(sharding.propagate(one, 40, rounds=0)).first()
    after = sharding.cut_links(sharding.propagate(one, 40)).first()
    # 350 of the 380 equal texts cannot be in one shard of 29 or 30
    assert before.linked == after.linked and after.apart <= 350 + 0.2 * (before.apart - 350)
    # groups that fit into a shard are whole
    texts = dict(rows)
    where = collections.defaultdict(set)
    for r in sharding.shard_documents(docs, 40).collect():
        where[texts[r.doc_id]].add(r.shard)
    small = [s for t, s in where.items() if t.startswith("group")]
    assert sum(len(s) == 1 for s in small) >= 0.75 * len(small)
    hot = [s for t, s in where.items() if t.startswith("hot")][0]
    assert len(hot) <= 25  # 380 rows need 13 shards of 30; it began in all 40


def test_rounds_never_change_sizes(spark):
    one = documents(spark, rows_with_groups(), clash=False).select(
        F.monotonically_increasing_id().alias("row_id"), F.xxhash64("doc_id").alias("order"), F.substring("text", 1, 7).alias("link"))
    for rounds in (0, 1, 3):
        sizes = [r["count"] for r in sharding.propagate(one, 7, rounds).groupBy("label").count().collect()]
        assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_few_and_no_rows(spark):
    got = sharding.shard_documents(documents(spark, odd_rows()[:3]), 40).collect()
    assert len({r.shard for r in got}) == 3 and {r.slot for r in got} == {0}
    assert sharding.shard_documents(empty(spark), 40).count() == 0


def apart(spark, texts, shards=40):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = sharding.shard_documents(documents(spark, rows, clash=False), shards).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(rows)
    by = collections.defaultdict(collections.Counter)
    for r in got:
        by[texts[r.doc_id]][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in by.values())


def test_every_text_twice_ends_with_every_pair_together(spark):
    assert apart(spark, [f"text {i % 2000}" for i in range(4000)]) <= 4


def test_pairs_and_unlinked_rows(spark):
    assert apart(spark, [f"text {i % 900}" for i in range(1800)] + [f"alone {i}" for i in range(200)]) == 0


def test_links_that_compete_for_shards(spark):
    texts = [f"group {g} of {n}" for g, n in enumerate([20, 15, 12, 10, 8, 5, 5, 3, 2, 2] * 12) for _ in range(n)]
    assert apart(spark, texts, 24) <= 0.06 * len(texts)


def test_one_id_on_a_third_of_the_rows_is_no_group(spark):
    rows = [(7, prose(5, i)) for i in range(1500)] + [(10 + i, prose(5, 5000 + i)) for i in range(3000)]
    base = documents(spark, rows, clash=False)
    sharding_rows, sharding.GROUP_ROWS = sharding.GROUP_ROWS, 100
    try:
        got = sharding.shard_documents(base, 4).collect()
    finally:
        sharding.GROUP_ROWS = sharding_rows
    per = collections.Counter(r.shard for r in got if r.doc_id == 7)
    assert len(got) == 4500 and max(per.values()) < 1.3 * min(per.values())


def test_rounds_cost_tasks_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    """Tables of a round are written by as many tasks as their rows need, and their tables stay few."""
    real, files = sharding.stored, []

    def noted(session, df, name):
        out = real(session, df, name)
        files.append((name, len(out.inputFiles())))
        return out

    one = documents(spark, rows_with_groups(), clash=False).select(
        F.monotonically_increasing_id().alias("row_id"), F.xxhash64("doc_id").alias("order"), F.col("text").alias("link"))
    one = real(spark, one, "vertices")
    keys = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    monkeypatch.setattr(sharding, "stored", noted)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        sharding.propagate(one, 40, rounds=2)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(n for _, n in files) <= sharding._tasks(one.count())
    assert len(files) <= 2 + 3 * 4  # two to begin with, four a round

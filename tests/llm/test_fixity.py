import os
import shutil

from pyspark.sql import functions as F

from relspark.llm import fixity

SCHEMA = "page_id long, url string, html string"


def pages(spark, n=300):
    rows = [(i, f"http://h/{i}", f"<p>page {i} é\r\n\r\nWARC/1.0</p>" * (i % 5)) for i in range(n)]
    rows += [(n, None, None), (None, "u", "x"), (n + 1, "", "y" * 100_000), (3, "http://h/3", "again")]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' archive", "1 offset", "2 node", "3 hash", "4 digest")


def records(spark, n=300):
    return fixity.page_records(pages(spark, n).drop("archive"), per_archive=64)


def test_undamaged_replicas_agree(spark):
    m = fixity.manifest(records(spark))
    assert fixity.audit(m, m, range_bytes=512).count() == 0
    none = m.where("archive = 99")
    assert fixity.audit(none, none).count() == 0
    assert fixity.audit(m, none).count() == m.count() and {r.state for r in fixity.audit(none, m).collect()} == {"added"}


def test_audit_finds_exactly_the_damaged_records(spark):
    m = fixity.manifest(records(spark))
    bad = m.where("record_id is null or record_id % 37 <> 5")
    bad = bad.withColumn("digest", F.when(F.col("record_id") % 41 == 2, F.unhex(F.lit("00"))).otherwise(F.col("digest")))
    for size, fanout in ((64, 2), (512, 4), (1 << 16, 16)):
        got = {(r.record_id, r.state) for r in fixity.audit(m, bad, range_bytes=size, fanout=fanout).collect()}
        lost = {(i, "lost") for i in range(302) if i % 37 == 5}
        changed = {(i, "changed") for i in range(302) if i % 41 == 2 and i % 37 != 5}
        assert got == lost | changed


def test_only_differing_branches_are_followed(spark):
    m = fixity.manifest(records(spark))
    tree = fixity.merkle_tree(m, 3, range_bytes=256, fanout=4)
    other = fixity.merkle_tree(m.withColumn("length", F.when(F.col("record_id") == 70, 1).otherwise(F.col("length"))), 3, range_bytes=256, fanout=4)
    for a, b in zip(tree, other, strict=True):
        assert a.exceptAll(b).count() == 1 and a.count() == b.count()


def test_written_archives_round_trip_and_damage_on_disk_is_located(spark, tmp_path):
    good, copy = str(tmp_path / "a"), str(tmp_path / "b")
    plain = records(spark).where("record_id is not null and record_id <> 3")
    fixity.write_warc(plain, good)
    back = fixity.read_warc(spark, good)
    want = fixity.manifest(plain)
    cols = ["archive", "record_id", "offset", "length", "digest"]
    assert back.select(*cols).exceptAll(want.select(*cols)).count() == 0 and back.count() == want.count()
    shutil.copytree(good, copy)
    folder = os.path.join(copy, "archive=1")
    name = next(f for f in os.listdir(folder) if f.endswith(".txt"))
    target = want.where("record_id = 99").first()
    with open(os.path.join(folder, name), "r+b") as f:
        f.seek(target.offset + target.length - 10)
        f.write(b"#")
    for crc in (f for f in os.listdir(folder) if f.endswith(".crc")):
        os.remove(os.path.join(folder, crc))
    found = fixity.audit(back, fixity.read_warc(spark, copy), range_bytes=256).collect()
    assert [(r.archive, r.record_id, r.offset, r.state) for r in found] == [(1, 99, target.offset, "changed")]


def test_one_id_on_a_third_of_the_records_is_cut_into_ranges(spark, monkeypatch):
    rows = [(i % 40, 7 if i % 3 == 0 else i, 10 + i % 5, bytes([i % 11])) for i in range(900)] + [(None, None, 3, b"x")] * 50
    rows = [(1 if i % 3 == 0 else a, r, n, d) for i, (a, r, n, d) in enumerate(rows)]
    df = spark.createDataFrame(rows, "archive long, record_id long, length long, digest binary").repartition(6).selectExpr("*", "1 range_no", "2 before")
    tables, plain = [], fixity.stored
    monkeypatch.setattr(fixity, "stored", lambda s, t, name: tables.append(plain(s, t, name)) or tables[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fixity.with_offsets(df)
        assert got.columns == [*df.columns, "offset"]
        got = sorted(((r.archive is not None, r.archive or 0, r.offset, r.record_id or 0, r.length) for r in got.collect()))
        per = tables[0].where("record_id = 7").groupBy("range_no_").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) >= 3 and max(r["count"] for r in per) < 200
    assert sorted((known, a, r, n) for known, a, _, r, n in got) == sorted((a is not None, a or 0, r or 0, n) for a, r, n, _ in rows)
    ends = {}
    for known, a, offset, _, n in got:
        assert offset == ends.get((known, a), 0)
        ends[known, a] = offset + n

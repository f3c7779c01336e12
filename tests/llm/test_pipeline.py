import importlib
import sys

import corpus_pipeline
from relspark.llm import near_dups, registry

from . import brute

SF = "/root/testdata/sf0.001"


def test_registered(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found and all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(found)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == before
        if name == "near_dups":
            again = near_dups.near_duplicates(docs)
            assert again.where("not kept").count() == 0
        if name == "secrets":
            assert not [r for r in docs.collect() if brute.base_secrets(r.text)]
            redacted = {r.doc_id: r.text for r in docs.collect()}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert {r.doc_id: r.decoded for r in docs.collect()} == redacted


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("relspark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name == "relspark.llm":
                raise ModuleNotFoundError(name, name=name)

    import relspark

    monkeypatch.delattr(relspark, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hide(), *sys.meta_path])
    importlib.invalidate_caches()
    assert not [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert registry.QUERIES


def odd_folder(spark, path, rows):
    from pyspark.sql import functions as F

    from .data import CLASH

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                       *[F.lit("x").alias(c) for c in CLASH])
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [(1, " ".join(f"q{i}" for i in range(40))), (2, None), (None, ""), (3, "two words")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_nulls_blanks_ties_repeats_and_clashing_names(spark, tmp_path, monkeypatch):
    from relspark.llm import quality

    from .data import odd_rows, prose

    # every text is good: what the later stages do with it is in question here
    monkeypatch.setattr(quality, "THRESHOLD", -1.0)
    rows = odd_rows() + [(5, rows_text) for rows_text in [odd_rows()[4][1]] * 3] + [(i, prose(60, i)) for i in range(20, 60)]
    rows += [(70, " ".join(f"q{i}" for i in range(40))), (71, "key: token = abcdefgh1 " + prose(30, 9)), (72, " "), (72, " ")]
    path = odd_folder(spark, str(tmp_path / "odd"), rows)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    texts = dict(rows)
    assert set(range(20, 60)) <= set(out) and 70 not in out and out[71].decoded.startswith("key: [SECRET] ")
    assert None in out and 4 in out and len([i for i in (5, 6, 7, 12) if i in out]) == 1
    assert all(out[i].decoded == texts[i] and out[i].n_tokens == len(out[i].ids) for i in range(20, 60))


def test_empty_table(spark, tmp_path):
    path = odd_folder(spark, str(tmp_path / "none"), [])
    assert corpus_pipeline.run(spark, path).count() == 0

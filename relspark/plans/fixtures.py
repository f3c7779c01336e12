"""``rel_*`` fixture tables derived from the driver tables (documents, labels, nation,
region, embeddings), so that every operator runs over whole tables and has a SQL oracle.

* ``rel_labels``: one relation class per nation, named ``REGION:NATION``; id 0 plays "no
  relation".
* ``rel_texts``: one example per document with a word.  The sentence is the whole document
  text with line breaks turned into spaces; the entities are its first and last word (swapped
  on odd ``doc_id`` so both span orders occur; the same word in a one-word document).
* ``rel_examples``: the same with a relation: labelled documents carry the class of
  ``doc_id mod 25``; the rest are ``blind``.
* ``rel_scores``: the 64 embedding numbers read as four 16-class models.
* ``rel_answers``: the embedding's class label as the answer.
* ``rel_hypothesis_scores``: the 64 numbers as 32 two-wide hypothesis score rows.
* ``rel_classes``: whole texts with the document's language as the class (English plays "no
  relation"); every fifth id is held out.
* ``rel_tagged_tokens``: the words of each part's type, name and brand, tagged by which they are, and
  of each nation's and region's name.
* ``rel_entity_names``: what is to be tagged: part names and brands in other orders, and the entities of
  ``rel_texts``.
* ``rel_pieces``: a piece table for subword encoding: the words of ``benchmark``, their first one to
  three characters, and any one or two later characters as continuations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import label_dimension

N_MODELS = 4
MODEL_WIDTH = 16
N_HYPOTHESIS_ROWS = 32
_PIECE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the DataFrame (file listing and footer schema) is reused per session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


_FIXTURES: dict[tuple[str, str, str], DataFrame] = {}


def _memo(fn):
    """Build a fixture DataFrame once per session and folder (DataFrames are immutable)."""

    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), fn.__name__)
        if key not in _FIXTURES:
            _FIXTURES[key] = fn(spark, sf_dir)
        return _FIXTURES[key]

    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@_memo
def rel_labels_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("int").alias("label_id"),
        F.concat(F.col("r_name"), F.lit(":"), F.col("n_name")).alias("label_name"),
    )


@_memo
def rel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``LABEL_DIM`` of the fixture."""
    return label_dimension(rel_labels_raw(spark, sf_dir))


@_memo
def rel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, sentence, entity_01, entity_02, e1_s, e1_e, e2_s, e2_e``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sentence = F.trim(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    b = docs.select(F.col("doc_id"), sentence.alias("sentence")).filter(F.col("sentence") != "")
    # first and last space-separated word, without materialising the word array
    t = b.select(
        "doc_id",
        "sentence",
        F.substring_index("sentence", " ", 1).alias("a"),
        F.substring_index("sentence", " ", -1).alias("z"),
    )
    even = (F.col("doc_id") % 2) == 0
    ln = F.length("sentence")
    la, lz = F.length("a"), F.length("z")
    return t.select(
        F.col("doc_id").alias("example_id"),
        F.col("sentence"),
        F.when(even, F.col("a")).otherwise(F.col("z")).alias("entity_01"),
        F.when(even, F.col("z")).otherwise(F.col("a")).alias("entity_02"),
        F.when(even, F.lit(0)).otherwise(ln - lz).cast("int").alias("e1_s"),
        F.when(even, la - 1).otherwise(ln - 1).cast("int").alias("e1_e"),
        F.when(~even, F.lit(0)).otherwise(ln - lz).cast("int").alias("e2_s"),
        F.when(~even, la - 1).otherwise(ln - 1).cast("int").alias("e2_e"),
    )


@_memo
def rel_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rel_texts`` with ``relation``."""
    # The labels table holds one row per labelled document (doc_id is its key).
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__l"))
    names = rel_labels_raw(spark, sf_dir).select(
        F.col("label_id").alias("__nk"), F.col("label_name").alias("__name")
    )
    joined = rel_texts(spark, sf_dir).join(labels, F.col("example_id") == F.col("__l"), "left")
    # nation has 25 rows by definition of the schema: a proven bound for the broadcast.
    joined = joined.join(F.broadcast(names), (F.col("example_id") % 25).cast("int") == F.col("__nk"))
    relation = F.when(F.col("__l").isNull(), F.lit("blind")).otherwise(F.col("__name"))
    return joined.withColumn("relation", relation).drop("__l", "__nk", "__name")


@_memo
def rel_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SCORES``: four 16-class models cut from each embedding."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("example_id"),
        F.lit(0).alias("variant"),
        F.posexplode(
            F.array(
                *[
                    F.slice(F.col("embedding"), m * MODEL_WIDTH + 1, MODEL_WIDTH)
                    for m in range(N_MODELS)
                ]
            )
        ).alias("m", "s"),
    ).select(
        "example_id",
        F.col("variant").cast("int").alias("variant"),
        F.col("m").cast("string").alias("model_id"),
        F.col("s").cast("array<double>").alias("scores"),
    )


@_memo
def rel_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ANSWER``: the embedding's class label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("example_id"), F.col("label").cast("int").alias("answer")
    )


@_memo
def rel_hypothesis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SCORES`` of 2-wide hypothesis rows: variant v = numbers 2v, 2v+1 (v in 0..31)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("example_id"),
        F.posexplode(
            F.array(*[F.slice(F.col("embedding"), v * 2 + 1, 2) for v in range(N_HYPOTHESIS_ROWS)])
        ).alias("variant", "s"),
    ).select(
        "example_id",
        F.col("variant").cast("int").alias("variant"),
        F.lit("0").alias("model_id"),
        F.col("s").cast("array<double>").alias("scores"),
    )


# fixed values: the first pieces of the fixture's table
SPECIAL_PIECES = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[E1]", "[/E1]", "[E2]", "[/E2]", "[E1-NER]", "[E2-NER]")


@_memo
def rel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``piece, piece_id``: the special pieces, then all others in order."""
    text = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_PIECE_WORD), 0)).alias("w")).distinct()
    head = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.col("w"), F.lit(1), n))
    places = F.when(F.length("w") > 1, F.sequence(F.lit(2), F.length("w"))).otherwise(F.array().cast("array<int>"))
    one, two = (F.transform(places, lambda i: F.concat(F.lit("##"), F.substring(F.col("w"), i, n))) for n in (F.lit(1), F.lit(2)))
    pieces = text.select(F.explode(F.concat(F.array("w"), head, one, two)).alias("piece")).distinct()
    # a vocabulary: one ordered partition of bounded size
    numbered = pieces.withColumn("piece_id", F.row_number().over(Window.orderBy("piece")) + len(SPECIAL_PIECES) - 1)
    special = spark.createDataFrame([(p, i) for i, p in enumerate(SPECIAL_PIECES)], "piece string, piece_id int")
    return special.unionByName(numbered)


# fixed values: class numbers of the fixture's languages; any other is "no relation"
LANGUAGE_CLASSES = {"de": 1, "es": 2, "fr": 3}


@_memo
def rel_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, sentence, label, held``."""
    label = F.lit(0)
    for name, number in LANGUAGE_CLASSES.items():
        label = F.when(F.col("lang") == name, number).otherwise(label)
    sentence = F.coalesce(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), sentence.alias("sentence"), label.cast("int").alias("label"), (F.col("doc_id") % 5 == 0).alias("held"))


@_memo
def rel_tagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sequence, position, token, tag``."""
    def tagged(c, tag):
        return F.transform(F.split(F.col(c), " "), lambda w: F.struct(w.alias("token"), F.lit(tag).alias("tag")))

    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("sequence"), F.concat(tagged("p_type", "TYPE"), tagged("p_name", "NAME"), tagged("p_brand", "BRAND")).alias("t"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sequence"), F.concat(tagged("n_name", "PLACE"), tagged("r_name", "AREA")).alias("t"))
    return part.unionByName(place).select("sequence", F.posexplode("t").alias("position", "t")).select("sequence", "position", "t.token", "t.tag")


@_memo
def rel_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity``."""
    part = table(spark, sf_dir, "part").select(F.explode(F.array(
        F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_brand", "p_name"))).alias("entity"))
    return part.unionByName(rel_texts(spark, sf_dir).select(F.explode(F.array("entity_01", "entity_02")).alias("entity")))

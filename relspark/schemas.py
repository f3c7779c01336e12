"""Fixed schemas of every table shape the library reads or produces."""

from __future__ import annotations

from pyspark.sql import types as T

# Hidden label of unlabelled ("blind") examples, carried as if it were a class id.
BLIND_RELATION = "blind"
BLIND_LABEL = 100

# Raw example file: tab separated, no header, positions 0..8.
RAW_EXAMPLE = T.StructType(
    [
        T.StructField("row_tag", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("entity_01", T.StringType()),
        T.StructField("e1_s", T.IntegerType()),
        T.StructField("e1_e", T.IntegerType()),
        T.StructField("entity_02", T.StringType()),
        T.StructField("e2_s", T.IntegerType()),
        T.StructField("e2_e", T.IntegerType()),
        T.StructField("relation", T.StringType()),
    ]
)

# Tagged example file: comma separated, one header line, positions 0..4.
TAGGED_EXAMPLE = T.StructType(
    [
        T.StructField("row_tag", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("entity_01", T.StringType()),
        T.StructField("entity_02", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

EXAMPLE = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("sentence", T.StringType()),
        T.StructField("entity_01", T.StringType()),
        T.StructField("entity_02", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

MARKED_EXAMPLE = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("sentence", T.StringType()),
        T.StructField("e1_s", T.IntegerType()),
        T.StructField("e1_e", T.IntegerType()),
        T.StructField("e2_s", T.IntegerType()),
        T.StructField("e2_e", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("spans_overlap", T.BooleanType()),
    ]
)

LABEL_DIM = T.StructType(
    [
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("label_name", T.StringType(), False),
        T.StructField("subject_part", T.StringType()),
        T.StructField("attribute_part", T.StringType()),
    ]
)

TEMPLATE_DIM = T.StructType(
    [
        T.StructField("label_id", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("forward", T.StringType()),
        T.StructField("reverse", T.StringType()),
        T.StructField("extra", T.ArrayType(T.StringType())),
    ]
)

MODEL_INPUT = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("variant", T.IntegerType(), False),
        T.StructField("style", T.StringType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("text_pair", T.StringType()),
        T.StructField("max_length", T.IntegerType(), False),
    ]
)

HYPOTHESIS = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("variant", T.IntegerType(), False),
        T.StructField("label_id", T.IntegerType(), False),
        T.StructField("direction", T.IntegerType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("text_pair", T.StringType()),
        T.StructField("max_length", T.IntegerType(), False),
        T.StructField("target", T.IntegerType()),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("variant", T.IntegerType(), False),
        T.StructField("model_id", T.StringType(), False),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("pred", T.IntegerType()),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField("example_id", T.LongType(), False),
        T.StructField("answer", T.IntegerType()),
    ]
)

# Experiment config: one flat JSON object per file.  ``file`` comes from file metadata.
EXPERIMENT_KEYS = [
    "seed",
    "MODEL_NAME",
    "output_dir",
    "logging_dir",
    "EPOCH",
    "optimizer",
    "learning_rate",
    "batch_size",
    "rtq",
    "two_sentence",
    "except_0",
    "entity_token",
]

EXPERIMENT_JSON = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("MODEL_NAME", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("logging_dir", T.StringType()),
        T.StructField("EPOCH", T.LongType()),
        T.StructField("optimizer", T.StringType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("rtq", T.StringType()),
        T.StructField("two_sentence", T.StringType()),
        T.StructField("except_0", T.StringType()),
        T.StructField("entity_token", T.StringType()),
    ]
)

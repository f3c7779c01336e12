"""relspark: the data side of relation classification as Spark DataFrame operators.

Every operator takes and returns a DataFrame keyed by an explicit ``example_id``
(plus ``variant`` / ``model_id`` where rows fan out), so that it can be chained with
``DataFrame.transform`` and planned by Catalyst as one lazy query.

Layout
------
``relspark.schemas``     fixed StructTypes of every table shape
``relspark.session``     SparkSession construction and shared configuration
``relspark.functions``   Column -> Column helpers (score math, templates, span marking)
``relspark.operators``   DataFrame -> DataFrame operators (labels, inputs, targets, decoders, metrics, jobs)
``relspark.sources``     readers and writers (TSV/CSV examples, templates, configs, predictions)
``relspark.plans``       size-checked broadcasts, end-to-end compositions (``flows``), fixture
                        tables, registered queries and their SQL oracles, plan inspection
``relspark.streaming``   per-row operators wired to Structured Streaming sources and sinks
"""

__version__ = "0.1.0"

"""salesops — retail sales analytics as Spark DataFrame operators.

Public operators take and return a ``pyspark.sql.DataFrame`` (or a ``Column``
for the expression helpers in :mod:`salesops.functions`). Most only build a
plan; those that fix an order or settle a batch step by step run jobs while
they build it and say so. What reaches the driver is bounded: one row per
partition, per leaf of a tree, or a sample of a stated size.

Layout::

    functions/   column expressions (dates, text, numbers, messages)
    sources/     the test-table mapping, file sources and sinks, catalog
    operators/   cleaning, charts, market basket, validation, records,
                 profile, messages, barcode debounce
    plans/       reusable plan shapes (calendar grids, numbering)
    streaming/   Structured Streaming versions of debounce and sale intake
    llm/         operators for training-data pipelines
"""

from salesops.session import build_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

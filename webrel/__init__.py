"""webrel: captured web data as Spark relations.

HTML pages become token / element / text tables, read in one pass per page;
what is asked of them are DataFrame expressions.  Extraction, link graphs,
change detection, request-log analytics and entity normalisation are DataFrame ->
DataFrame functions meant to be chained with ``df.transform``.
"""

from webrel.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]

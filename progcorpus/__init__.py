"""Program-corpus curation as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.  The only Python crossing is the syntax-tree job in
``operators.nodes`` (``mapInArrow`` over distinct program texts).
"""

from progcorpus.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]

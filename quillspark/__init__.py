"""quillspark — Spark-native rebuild of a content site's data work.

Three kinds of work, each expressed as DataFrame -> DataFrame (or Column)
functions that Catalyst plans and optimises:

* experiment-data preparation (``operators.prep``)
* queries over dated, tagged records (``operators.listing``, ``operators.taxonomy``)
* search and nested-archive analytics (``operators.search``, ``sources.archive``)
"""

from quillspark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

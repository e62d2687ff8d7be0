"""tabulon: exploratory table analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, so Catalyst can prune columns, push filters into the scan and plan
the shuffles.  Only small aggregate rows (bounds, medians, short category
lists) ever reach the driver.
"""

from tabulon.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

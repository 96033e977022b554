"""riskfold: portfolio-risk and market-news analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function; nothing is collected to the driver on the data path.
"""

__version__ = "0.1.0"

"""formbook — Spark-native analytics over ball-by-ball sports data.

Every operator is a lazy ``DataFrame -> DataFrame`` function whose
thresholds are keyword parameters; nothing is pulled to the driver.
"""

__version__ = "0.1.0"

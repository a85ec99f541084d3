"""Customer churn analytics and effect analysis as Spark DataFrame jobs."""

__version__ = "0.1.0"

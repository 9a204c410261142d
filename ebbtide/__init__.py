"""ebbtide: customer-churn analytics as Spark DataFrame and Spark ML jobs."""

__version__ = "0.1.0"

"""hourloom - Spark DataFrame operators for hourly measurements at places."""

__version__ = "0.1.0"

"""Signal discovery over dated, company-attributed free-text records, on Spark."""

__version__ = "0.1.0"

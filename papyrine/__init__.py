"""papyrine: document processing as Spark plans and Column functions."""

__version__ = "0.1.0"

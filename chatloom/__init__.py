"""Chat-data curation and evaluation pipelines for PySpark DataFrames."""

"""Training-data operators: ten document, page and corpus operators as Spark
jobs, and the queries that apply them. Nothing else in the library imports
this subpackage."""

"""Corpus analytics on Spark: search, stage pipelines, reducers and maintenance jobs as DataFrame plans."""

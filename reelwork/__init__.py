"""Reelwork: deterministic data work around model-annotated video, on Spark DataFrames."""

"""Papyrion: document preparation, retrieval and training-data operators on Spark DataFrames."""

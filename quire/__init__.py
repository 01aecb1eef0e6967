"""quire: paged documents to section trees, ranked retrieval and answers, on Spark DataFrames."""

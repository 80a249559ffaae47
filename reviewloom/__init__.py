"""Review analytics as Spark DataFrame jobs.

``sources``    reading reviews and cached model answers, writing results
``functions``  Column expressions: cleaning, tokens, answer parsing, keys
``operators``  DataFrame -> DataFrame: clean, profile, count, infer, aggregate
``plans``      whole jobs put together from the operators
"""

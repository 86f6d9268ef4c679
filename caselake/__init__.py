"""caselake: case and vaccination time series on Spark DataFrames.

``functions``  column expressions (dates, numbers, names, ratios)
``sources``    readers, writers, the table store and the run log
``operators``  DataFrame -> DataFrame building blocks
``plans``      the four loads, the serving tables and the reports
``checks``     inputs derived from the given tables, queries and their SQL
"""

"""fiscus: taxpayer statistics and revenue forecasting as Spark jobs.

Sub-packages
------------
``sources``    reading and writing: tables, CSV, JDBC, summary tables
``functions``  column expressions and the fixed rule tables
``operators``  DataFrame -> DataFrame building blocks
``plans``      the user-level questions, each with its check SQL
"""

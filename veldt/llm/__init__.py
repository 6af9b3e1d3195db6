"""Operators for building large text training sets on Spark.

Every operator takes DataFrames and returns DataFrames; nothing outside this
subpackage imports it.  ``queries`` registers one query per operator.
"""

"""lorekiln: a Spark-native engine for building, validating and evaluating question/answer corpora.

Every operator takes and returns DataFrames. Optional operators for training data live in ``lorekiln.llm``; nothing
outside that subpackage imports it.
"""

"""Operators for preparing language-model training data.

Nothing outside this package imports it; the package itself only uses Spark,
numpy and pyarrow (and the tokenizer library where token ids are asked for).
"""

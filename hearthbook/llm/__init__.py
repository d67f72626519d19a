"""Corpus operators for large text, page, media and vector tables.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; intermediate results that several jobs read are written as Parquet
under the shared folder of ``spark.checkpoint.dir`` (see ``_store``), so that a
lost executor costs only its running tasks.
"""

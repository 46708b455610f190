"""quillforge: curate rubric-graded question/answer data on Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame transforms),
``sources`` (readers and writers), ``plans`` (loops and the query catalogue) and
``streaming`` (file-stream wrappers).
"""

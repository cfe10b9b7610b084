"""Filing-evidence analytics as Spark DataFrame jobs.

Subpackages: ``operators`` (the named operations), ``plans`` (how the driver
tables stand in for disclosure entities), ``functions`` (column helpers),
``sources`` (archive reader), ``streaming`` (event stream extras) and ``llm``
(training-data operators; nothing else imports it).
"""

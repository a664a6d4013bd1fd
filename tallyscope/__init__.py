"""tallyscope: Spark jobs for scored and labelled collections.

Layout: ``functions`` (Column -> Column), ``sources`` (readers, writers and
fixed dimension tables), ``operators`` (DataFrame -> DataFrame), ``streaming``
(Structured Streaming jobs) and ``plans`` (registered queries with their SQL
twins).
"""

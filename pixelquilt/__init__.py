"""pixelquilt: Spark jobs that turn sample tables into vision-text training and serving rows.

``functions``  Column -> Column expressions (prompts, tags, geometry, token arrays)
``operators``  DataFrame -> DataFrame steps (sharding, batching, padding, mixture, meters)
``sources``    readers and writers
``plans``      the jobs a user runs, composed from the two above
``streaming``  incremental forms over newly arrived files
``catalog``    the registered queries and their SQL twins
"""

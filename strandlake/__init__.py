"""strandlake: a Spark-first engine for sequencing-read archives.

``functions`` holds Column builders, ``operators`` the relational operators, ``plans`` the
end-to-end jobs (compress, restore, verify), ``sources`` the readers and writers and
``streaming`` the incremental ingest.
"""

__version__ = "0.1.0"

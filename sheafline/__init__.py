"""Harvested web text to typed, quality-checked tables, as Spark DataFrames.

``functions``  column expressions (text, urls, html, chunking, comparison)
``operators``  DataFrame -> DataFrame steps (web, search, tables, quality, ...)
``sources``    readers, writers and the batch half of the event log
``streaming``  the Structured Streaming half of the event log
``plans``      whole jobs built from the above, and the query catalogue
"""

__version__ = "0.1.0"

"""Writers: places, enrichments and tracks as GeoJSON, GPX and KML.

A document is a table of text lines (``doc_id, section, ord, text``). Lines are
ordered and written by range, so a document of any size is written by many tasks
and its part files, read in order, are the document.
"""

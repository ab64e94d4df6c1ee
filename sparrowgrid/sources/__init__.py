"""Sources: captured responses, their parsers, seeds, tables, and views of the test tables."""

"""weftline: a PySpark engine for preparing, measuring and searching text corpora."""

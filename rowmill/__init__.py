"""rowmill: a PySpark engine for scanned housing-register forms and the texts around them."""

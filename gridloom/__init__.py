"""gridloom: a PySpark-native extract, enrich, index and search engine for pages about people."""

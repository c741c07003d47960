"""corpusmill: a PySpark-native engine that turns semi-structured text into tables and a linked graph."""

"""A PySpark-native engine for organising, searching and cleaning large collections of documents."""

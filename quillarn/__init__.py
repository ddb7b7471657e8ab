"""quillarn: a PySpark-native engine for building and scoring question-answering data."""

"""A PySpark-native engine for document distillation, retrieval and usage analytics."""

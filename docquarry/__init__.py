"""docquarry: a PySpark-native engine that acquires, cleans, classifies and searches document collections."""

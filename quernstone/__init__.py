"""quernstone: a PySpark-native engine for delimited tables, key joins, line indexes and transaction schedules."""

"""lodestrand: a PySpark-native engine for code similarity, dependence analysis and ranked evidence."""

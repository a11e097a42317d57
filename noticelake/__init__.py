"""noticelake: a PySpark-native engine for announcement feeds and text corpora."""

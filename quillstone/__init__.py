"""PySpark-native transcription-evidence analytics."""

"""Spark-native analytics for periodic count series."""

from tallyspan.config import ModelSettings, StudyScope

__all__ = ["ModelSettings", "StudyScope"]

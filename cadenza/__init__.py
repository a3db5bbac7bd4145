"""Spark-native analytics for event calendars gathered from many sources."""

"""Marker-recoverability analytics on Spark: declarative operators over cell, marker and patient tables."""

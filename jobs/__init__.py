"""Runnable jobs: a command line and a configuration file each, Spark's readers, writers and streams, and the library's operators."""

"""Tidelog: last-writer-wins analytics over key-value mutation logs, on Spark."""

"""Spark-first corpus analytics: text kernel, segmentation, retrieval, validation and evaluation."""

"""Counting over streams of reads."""

"""Training-data operators: URL filters, secret scans, decontamination, chat
formatting, toxicity, exact top-k, HTML extraction, WARC, Jaccard join, mixing.

Nothing outside this subpackage imports it.
"""

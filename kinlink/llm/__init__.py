"""Training-data operators for very large text corpora.

Each module holds one operator; ``queries`` holds the registered queries and their SQL.  Nothing outside this
subpackage imports it.
"""

"""Readers of KEEL and ARFF text, partition folders and result shards; writers of results."""

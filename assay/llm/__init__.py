"""Training-data operators: quality, chat formatting, deduplication, decontamination and mixing.

Tables of documents have doc_id (integer) and text, and may have any other columns, which operators
pass on. Names that begin with two underscores are reserved.
"""

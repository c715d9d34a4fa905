"""Training-data operators: deduplication, language ID, tokenising, packing, sharding, fingerprints, licences, chat.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface; ``queries.py``
applies the operators to the tables with production parameters.
"""

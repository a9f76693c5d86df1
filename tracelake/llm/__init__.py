"""Training-data operators: packing, deduplication, language ID, PII and friends.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``tracelake.llm.queries`` registers one thin ``opN_<name>`` query
for each of them.
"""

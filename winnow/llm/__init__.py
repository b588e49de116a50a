"""Training-data operators: dedup, filtering, scoring, sharding and packing of text.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame plus the names of its id and text columns and returns a DataFrame;
``queries`` holds the registered queries and their SQL.
"""

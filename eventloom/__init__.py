"""eventloom: event-listing integration on Spark DataFrames.

Captured pages, page texts and social captions are extracted, normalised to
one record shape, resolved to unique events, merged and reported, all as
DataFrame transformations.
"""

"""Training-data operators (URL rules, packing, nearest neighbours, chat
formatting, quality, near duplicates, token counts, mixing, token files).

Nothing else in the library imports this subpackage.
"""

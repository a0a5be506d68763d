"""Training-data operators: mixing, rules, token output, deduplication, archives, search, models, chat, tokens.

One module per operator. Nothing else in the library imports this subpackage; it can be removed whole.
"""

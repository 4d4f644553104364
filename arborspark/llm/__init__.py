"""Training-data operators: ten corpus-scale components on whole documents.

Nothing else in the library imports this subpackage; it can be removed on its own.
"""

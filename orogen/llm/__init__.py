"""Training-data operators: text, vectors and web pages at corpus scale.

Nothing else in the library imports this subpackage.
"""

"""Training-data corpus operators.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries, ``corpus_pipeline.py`` at the repository top chains five of them.
"""

"""Training-data operators: tokens, near-duplicates, personal data,
toxicity, language, token roll-ups, decontamination and licences.

Nothing else in the library imports this package; ``registry.Q`` lists its
queries.
"""

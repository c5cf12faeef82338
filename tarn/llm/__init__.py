"""Training-data operators: one module each, plus ``queries`` that applies them to whole tables."""

"""Rules: parsing, classes, canonical text, checking, repair, evaluation."""

"""Recipes over the operators: reading, censuses, derivations and the expression tree."""

"""Report tables composed from the operators: demography, adverse events, labs."""

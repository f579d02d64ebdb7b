"""Building-block operators (population, denominators, incidence, summaries, reshaping)."""

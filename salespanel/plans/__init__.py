"""Plans: the derived panel over the driver tables, and the run pipeline."""

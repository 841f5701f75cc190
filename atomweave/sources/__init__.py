"""Sources: trajectory files and adapters of relational tables to trajectories."""

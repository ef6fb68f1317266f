"""PySpark jobs for drifting wave-buoy trajectories."""

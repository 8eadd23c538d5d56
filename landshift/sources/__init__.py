"""Table scans, sinks and the observation tables the engine works on."""

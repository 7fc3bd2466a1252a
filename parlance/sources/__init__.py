"""Sources and sinks: result files, feeds, snapshots, and tables with the write semantics of the pipeline."""

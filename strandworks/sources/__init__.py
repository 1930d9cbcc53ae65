"""Sources and sinks of trace files."""

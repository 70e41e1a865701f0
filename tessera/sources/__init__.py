"""Sources and sinks: table readers, corpus scan, command lines, block output."""

"""Sources and sinks: tables, imports and exports."""

"""Sources and sinks: driver test tables, JSON / CSV files, JDBC."""

"""Writers: immutable runs, forecast tables, findings and wide exports."""

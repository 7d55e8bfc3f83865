"""Sources and sinks: export readers/writers and the test-table binding."""

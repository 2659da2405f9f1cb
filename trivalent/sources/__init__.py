"""Sources and sinks: versioned tables, pages of HTML, backups."""

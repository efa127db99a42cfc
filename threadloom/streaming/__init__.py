"""Following sources that grow, and operators over streams of records."""

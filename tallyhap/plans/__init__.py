"""End-to-end plans and the command line."""

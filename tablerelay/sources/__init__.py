"""Reading job inputs and run logs, and writing reports."""

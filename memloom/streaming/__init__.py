"""Extension beyond the reference: event streams as micro-batches of files."""

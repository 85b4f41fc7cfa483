"""Native column expressions; nothing here needs a Python worker."""

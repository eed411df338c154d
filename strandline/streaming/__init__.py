"""The store's incremental operators as structured streams."""

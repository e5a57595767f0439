"""Part of the document engine."""

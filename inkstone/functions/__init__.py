"""Part of the inkstone document-analytics engine."""

"""Whole jobs: from pixels, blocks or boxes to layers and summaries."""

"""Safety-data-sheet registry analytics as DataFrame jobs."""

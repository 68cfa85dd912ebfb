"""The 59 reports, one module per subject."""

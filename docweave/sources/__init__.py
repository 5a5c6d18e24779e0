"""File scans: discovery, text, HTML, office files, PDF tier cascade, JSON state."""

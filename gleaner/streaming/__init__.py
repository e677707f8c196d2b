"""Live scans."""

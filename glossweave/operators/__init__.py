"""Relational, vector and text operators over mention frames."""

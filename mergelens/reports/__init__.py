"""Reports as text: what a terminal or a markdown file shows."""

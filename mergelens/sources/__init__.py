"""Where pull requests come from and are kept."""

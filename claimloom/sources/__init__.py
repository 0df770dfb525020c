"""Where claims come from and where they are kept."""

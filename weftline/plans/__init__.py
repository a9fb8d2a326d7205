"""Plan helpers: materialised cuts of a plan, bounded broadcasts."""

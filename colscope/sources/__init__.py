"""Where catalogs, labels and feature blocks come from and go to."""

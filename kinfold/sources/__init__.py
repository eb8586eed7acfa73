"""Where metadata and state come from and go to."""

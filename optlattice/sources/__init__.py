"""Where data come from and go to."""

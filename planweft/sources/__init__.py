"""Where a plan's input sources come from."""

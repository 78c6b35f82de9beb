"""Results as they come: cursors and cancellable jobs."""

"""Where tables come from: the catalogue and the repository over one entity."""

"""Where rows go: files by a path column, topics, collections, several sinks at once."""

"""Where rows come from: line files, message topics, incremental pulls, inline rows, framed blobs."""

"""Where rows come from and where intermediate tables are kept."""

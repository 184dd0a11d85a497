"""Where rows come from and go to: driver tables, the versioned warehouse, CSV and GeoJSON exports."""

"""How plans are staged: written intermediate tables and join strategies."""

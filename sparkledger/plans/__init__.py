"""What may be asked: column catalogs, filters, query specifications and the routers that make them."""

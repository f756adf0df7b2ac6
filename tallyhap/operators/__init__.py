"""DataFrame operators: read filters, interval joins, counting, variants, phasing."""

"""Row-level operators: ordered neighbours, rotation links, filters, top-k."""

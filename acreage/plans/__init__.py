"""Views over the generated tables, the query catalogue and its SQL twins."""

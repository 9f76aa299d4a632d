"""File layouts, readers, writers and the test tables in their analytic roles."""

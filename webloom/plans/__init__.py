"""How queries are put together: derived views and written stages."""

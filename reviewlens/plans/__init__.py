"""Session, views and named queries."""

"""Named queries over the news tables, with their SQL."""

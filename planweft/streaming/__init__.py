"""Plans over unbounded sources: an extension of the plan language."""

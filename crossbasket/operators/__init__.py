"""DataFrame-to-DataFrame operators; none of them triggers an action."""

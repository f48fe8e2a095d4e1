"""Market and portfolio analytics as DataFrame operators."""

"""Gleaner: mining work leads from large streams of chat posts, as Spark DataFrame transforms."""

"""Training-data pipeline operators over ``documents`` / ``pages``; nothing else in the library imports this package."""

"""Analytics over AI-assistant conversation history, planned by Spark from end to end."""

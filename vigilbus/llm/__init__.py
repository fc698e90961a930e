"""Training-data operators; queries are registered by ``vigilbus.llm.queries``."""

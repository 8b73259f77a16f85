"""Multi-step plans and the named queries of the engine."""

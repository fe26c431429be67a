"""Ready-made plans: the registered queries and their SQL counterparts."""

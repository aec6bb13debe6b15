"""SQL counterparts of the operators, used only to check results on the driver's tables."""

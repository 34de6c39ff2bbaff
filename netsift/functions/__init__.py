"""Part of netsift."""

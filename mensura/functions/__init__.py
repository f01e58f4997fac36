"""Part of mensura."""

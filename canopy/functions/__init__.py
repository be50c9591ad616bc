"""Part of canopy."""

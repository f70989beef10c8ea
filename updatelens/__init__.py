"""updatelens: turn tables and streams of feed items into a few scored, explained updates."""

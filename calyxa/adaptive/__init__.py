"""Choice among strategies that give the same rows; it changes how fast, never what."""

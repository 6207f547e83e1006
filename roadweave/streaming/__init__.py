"""Jobs over streams of points and events."""

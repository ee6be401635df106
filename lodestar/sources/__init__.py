"""Sources: files of a folder, and the segments of their texts."""

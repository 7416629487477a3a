"""Running metrics over streams of scored samples."""
